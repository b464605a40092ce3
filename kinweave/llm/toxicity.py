"""Toxicity by maximum-scoring segments over token log-odds.

1. From labelled documents, each token gets its log-odds of toxic against clean
   documents under a Dirichlet prior; tokens of significant odds are the model.
2. One linear scan finds all maximal-scoring segments of a text (Ruzzo and
   Tompa, ISMB 1999): listed tokens score their log-odds, all others a small
   negative constant.
3. Under the background of clean documents a segment of score S in n tokens has
   the E-value K n exp(-lambda S) (Karlin and Altschul, PNAS 1990).  The evidence
   of the significant segments, their sum and their best, and the length of the
   text give the probability, by a logistic curve fitted on labelled documents
   that gave no token.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.worker import sliced
from kinweave.session import settle, ship_functions

ship_functions(__name__)

#: Labelled documents that a model is fitted on, at most; chosen by a hash of their id.
MAX_LABELLED = 100_000
#: Tokens of a model, at most; those of the highest significance stay.
MAX_TOKENS = 100_000
#: Pseudo-count of documents per token and class, and the significance (signed root of the
#: log-likelihood ratio, in standard deviations) from which a token is listed.
PRIOR, MIN_Z = 1.0, 4.0
#: E-value up to which a passage is significant.
E_VALUE = 0.05
#: Bytes of text handled at a time.
SLICE = 4_000_000
TOKEN = re.compile(r"[^\W\d_]+")
PASSAGES = "array<struct<start:int,end:int,score:double,e_value:double>>"


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return TOKEN.findall(text.lower()) if text else []


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score), left to right, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum at the end
    lower: list[int] = []  # the nearest segment to the left with a smaller sum before
    total = 0.0
    for i, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        first, left, total = i, total, total + score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, left, total))
                lower.append(j)
                break
            first, _, left, _ = found[j]
            del found[j:], lower[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class Model:
    """Token scores, the score of all other tokens, lambda, K and the logistic curve.

    Passages are scanned on plain scores, so equal passages are all found.  What
    the curve sees of a text counts the k-th use of a token for the k-th part:
    one word repeated over and over is weak evidence.
    """

    scores: dict[str, float]
    rest: float
    decay: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    e_value: float = E_VALUE

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(first token, last + 1, score, E-value, E-value with repeated tokens counted less) of the significant segments."""
        get = self.scores.get
        hits = [i for i, w in enumerate(words) if w in self.scores]
        if not hits:
            return []
        items, less, places, last = [], [], [], None
        used: Counter[str] = Counter()
        for i in hits:
            if last is not None and i - last > 1:
                items.append((i - last - 1) * self.rest)
                less.append(items[-1])
                places.append((last + 1, i))
            used[words[i]] += 1
            items.append(get(words[i]))
            less.append(items[-1] / used[words[i]])
            places.append((i, i + 1))
            last = i
        base = self.k * max(1, len(words))
        out = []
        for a, b, score in maximal_segments(items):
            expected = base * math.exp(-min(700.0, self.decay * score))
            if expected <= self.e_value:
                held = base * math.exp(-min(700.0, self.decay * max(0.0, sum(less[a:b]))))
                out.append((places[a][0], places[b - 1][1], score, expected, held))
        return out

    def probability(self, expected: list[float], size: int) -> float:
        z = sum(w * x for w, x in zip(self.curve, evidence(expected, size)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def evidence(expected: list[float], size: int) -> tuple[float, float, float, float]:
    """What the logistic curve sees of a text: the sum and the best of its evidence, its length, and one."""
    found = [max(0.0, -math.log(max(e, 1e-300))) for e in expected]
    return math.log1p(max(0.0, sum(found))), math.log1p(max(0.0, max(found, default=0.0))), math.log1p(size), 1.0


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y, part) of at most `most` labelled documents; of contradicting labels of one id the higher counts."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).where(learn)
    ids = ids.groupBy(F.col(id_col).alias("_kw_id")).agg(F.max(label).cast("int").alias("_kw_y"))
    ids = ids.orderBy(F.xxhash64("_kw_id"), "_kw_id").limit(most)
    chosen = settle(ids.withColumn("_kw_part", F.pmod(F.xxhash64(F.lit("part"), "_kw_id"), F.lit(4)).cast("int")))
    rows = docs.select(F.col(id_col).alias("_kw_id"), F.col(text).alias("_kw_text"))
    return rows.join(F.broadcast(chosen), "_kw_id").select("_kw_text", "_kw_y", "_kw_part")  # bounded by `most` rows


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text: str = "text",
        label: str = "toxic", most: int = MAX_LABELLED, max_tokens: int = MAX_TOKENS, min_z: float = MIN_Z,
        prior: float = PRIOR, e_value: float = E_VALUE) -> Model:
    """A model from those `labels` rows that `learn` selects (a condition on their columns).

    Three quarters of the documents give token odds, one quarter the background
    and the curve.  Rows without label, id or document are not used; without any
    label of one class the model finds nothing and scores the share of toxic ones.
    """
    learn = F.lit(True) if learn is None else learn
    rows = settle(_labelled(docs, labels, learn, id_col, text, label, most))
    sizes = {(r["_kw_y"], r["_kw_part"] == 0): r["n"] for r in rows.groupBy("_kw_y", "_kw_part").agg(
        F.count(F.lit(1)).alias("n")).groupBy("_kw_y", (F.col("_kw_part") == 0).cast("int").alias("_kw_part")).agg(
        F.sum("n").alias("n")).selectExpr("_kw_y", "1 - _kw_part AS _kw_part", "n").collect()}
    toxic, clean = (sizes.get((y, False), 0) for y in (1, 0))
    base = (sum(n for (y, _), n in sizes.items() if y == 1) + 0.5) / (sum(sizes.values()) + 1)
    none = Model({}, -1.0, curve=(0.0, 0.0, 0.0, math.log(base / (1 - base))), e_value=e_value)
    if not toxic or not clean:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (Counter(), Counter())
            length = [0, 0]
            for words, y in zip(map(tokens, batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                both[y].update(set(words))
                length[y] += len(words)
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([both[1][w] for w in names], pa.int64()),
                 pa.array([both[0][w] for w in names], pa.int64())], names=["token", "toxic", "clean"])

    counts = rows.where("_kw_part <> 0").select("_kw_text", "_kw_y").mapInArrow(
        count, "token string, toxic long, clean long").groupBy("token").agg(
        F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
    a, b = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a / (toxic + 2 * prior - F.least(a, F.lit(toxic) + prior))) - F.log(b / (clean + 2 * prior - F.least(b, F.lit(clean) + prior)))
    both = F.col("y1") + F.col("y0")
    ratio = F.col("y1") * F.log(F.col("y1") / (both * (toxic / (toxic + clean))))
    ratio = ratio + F.when(F.col("y0") > 0, F.col("y0") * F.log(F.col("y0") / (both * (clean / (toxic + clean))))).otherwise(0.0)
    listed = counts.where(F.col("y1") > 0).select("token", odds.alias("odds"), F.sqrt(2 * F.greatest(ratio, F.lit(0.0))).alias("z")).where(
        (F.col("odds") > 0) & (F.col("z") >= min_z)).orderBy(F.desc("z"), "token").limit(max_tokens).collect()
    if not listed:
        return none
    scores = {r["token"]: float(r["odds"]) for r in listed}

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text_, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text_)
                hits = Counter(round(scores[w], 1) for w in words if w in scores)
                out.append({"y": y, "n": len(words), "hits": [{"s": s, "n": n} for s, n in hits.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("y", pa.int32()), ("n", pa.int64()), ("hits", pa.list_(pa.struct([("s", pa.float64()), ("n", pa.int64())])))]))

    held = rows.where("_kw_part = 0").select("_kw_text", "_kw_y")
    seen = held.mapInArrow(profile, "y int, n long, hits array<struct<s:double,n:long>>")
    lengths = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    hits = seen.select("y", F.explode("hits").alias("h")).groupBy("y", "h.s").agg(F.sum("h.n").alias("n")).collect()
    share = sum(r["n"] for r in hits if r["y"] == 1) / max(1, lengths.get(1, 0))
    model = Model(scores, math.log(1 - min(0.5, max(share, 0.005))), e_value=e_value)
    # lambda: the positive root of E[exp(lambda s)] = 1 over the tokens of clean documents
    words_of_clean = max(1, lengths.get(0, 0))
    back = [(r["s"], (r["n"] + 0.0) / words_of_clean) for r in hits if r["y"] == 0] or [(max(scores.values()), 0.5 / words_of_clean)]
    neutral = 1 - sum(p for _, p in back)

    def excess(x: float) -> float:
        return neutral * math.exp(x * model.rest) + sum(p * math.exp(min(700, x * s)) for s, p in back) - 1

    low, high = 1e-3, 8.0
    if excess(low) < 0 < excess(high):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if excess(middle) < 0 else (low, middle)
        model.decay = low
    k_model, cut = Model(scores, model.rest, model.decay, 1.0, e_value=1e300), e_value

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text_, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text_)
                found = k_model.passages(words)
                out.append({"y": y, "n": len(words), "e": [p[3] for p in found], "less": [p[4] for p in found]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("y", pa.int32()), ("n", pa.int64()), ("e", pa.list_(pa.float64())), ("less", pa.list_(pa.float64()))]))

    seen = held.mapInArrow(measure, "y int, n long, e array<double>, less array<double>").collect()  # at most a quarter of `most` rows
    tops = [min(r["e"]) if r["e"] else r["n"] for r in seen if r["y"] == 0 and r["n"]]
    model.k = min(1.0, 1 / max(1e-9, float(np.mean(tops)))) if tops else 1.0
    x = [evidence([model.k * h for e, h in zip(r["e"], r["less"]) if model.k * e <= cut], r["n"]) for r in seen]
    model.curve = _logistic(np.array(x).reshape(-1, 4), np.array([r["y"] for r in seen], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method, slightly shrunk."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with toxicity (0 to 1), and passages: token spans with score and E-value.

    Every whole text is scanned.  Null and empty texts have no passage and the
    score of no evidence; repeated rows stay; columns of `docs` named like the
    two new ones are replaced; an empty table gives an empty one.  The model is
    broadcast; its size is bounded by `max_tokens`.
    """
    docs = docs.drop("toxicity", "passages")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = pa.struct([("p", pa.float64()), ("s", pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])))])

    @F.arrow_udf(f"p double, s {PASSAGES}")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(**shared.value)
        for batch in batches:
            out = []
            for text_ in (t for _, texts in sliced(batch, SLICE) for t in texts):
                words = tokens(text_)
                found = known.passages(words)
                out.append({"p": known.probability([f[4] for f in found], len(words)), "s": [
                    {"start": a, "end": b, "score": s, "e_value": e} for a, b, s, e, _ in found]})
            yield pa.array(out, kind)

    return docs.withColumn("_kw_t", scan(F.col(text))).select(
        *docs.columns, F.col("_kw_t.p").alias("toxicity"), F.col("_kw_t.s").alias("passages"))
