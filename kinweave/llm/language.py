"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters is a space, and their pairs and
triples of characters are hashed to `BUCKETS` features.  A feature's value is its
share of the text's n-grams times its inverse document frequency, which is counted
over all learning documents.  Weights are trained by follow-the-regularised-leader
with L1 and L2 penalties; a temperature fitted on documents kept back calibrates
the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.worker import cached, sliced
from kinweave.llm.words import LETTER, _classes
from kinweave.session import settle, ship_functions

ship_functions(__name__)

BUCKETS = 1 << 16
#: Labelled documents that weights are fitted on, at most, drawn by a hash of their id, evenly over the
#: languages; and the length up to which texts are preferred for it.
MAX_SAMPLE, MAX_CHARS = 4_000, 20_000
EPOCHS = 3
#: FTRL: learning rate, its offset, L1 and L2 penalties; features are multiplied by SCALE.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.001, 10.0
#: Bytes of text handled at a time.
SLICE = 2_000_000
UNKNOWN = "und"


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every pair and triple of the texts in a row, the place where each text starts, its letters.

    The places of pairs and triples alternate; those that would reach into the
    next text have the feature `BUCKETS`, which no weight belongs to.
    """
    table = cached("word classes", _classes)
    padded = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    letter = table[code] == LETTER
    code = np.where(letter, code, np.uint32(32))
    ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))
    starts = ends - np.fromiter(map(len, padded), np.int64, len(padded))
    a = code * np.uint32(0x9E3779B1)
    two = (a[:-1] ^ (code[1:] * np.uint32(0x85EBCA77)))
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ (code[2:] * np.uint32(0x27D4EB2F)) ^ np.uint32(0x165667B1)
    out = np.full((len(code), 2), BUCKETS, np.int64)
    out[:-1, 0] = (two ^ (two >> np.uint32(15))) % np.uint32(BUCKETS)
    out[:-2, 1] = (three ^ (three >> np.uint32(13))) % np.uint32(BUCKETS)
    out[ends - 1] = BUCKETS
    out[ends - 2, 1] = BUCKETS
    letters = np.add.reduceat(letter.astype(np.int64), starts)
    return out.reshape(-1), 2 * starts, letters


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dim: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (dim, classes) from rows of (features, values, class), in the given order."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        rate = (BETA + np.sqrt(ni)) / ALPHA + L2
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / rate)

    for _ in range(epochs):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def _nll(logits: np.ndarray, y: np.ndarray, t: float) -> float:
    s = logits / t
    s = s - s.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    a, b, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        if _nll(logits, y, math.exp(c)) <= _nll(logits, y, math.exp(d)):
            b = d
        else:
            a = c
    return math.exp((a + b) / 2)


def fit(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id",
        most: int = MAX_SAMPLE, max_chars: int = MAX_CHARS) -> dict:
    """A model from the documents that `learn` selects: languages, weights, idf, temperature.

    Rows without text or language are left out.  Languages and document frequencies
    are those of all rows; weights come from an equal share of `most` rows for
    each language, drawn by a hash of `key` and the text from those of up to
    `max_chars` code points, or from all where a language has too few of these.
    """
    rows = docs.where(F.lit(True) if learn is None else learn).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).alias("_kw_text"), F.col(lang).cast("string").alias("_kw_lang"),
                       F.xxhash64(F.col(key), F.col(text)).alias("_kw_hash"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, flag = np.zeros(BUCKETS + 1, np.int64), 0, np.zeros(BUCKETS + 1, bool)
        for batch in batches:
            for _, part in sliced(batch.column(0), SLICE):
                found, starts, _ = ngrams(part)
                seen += len(part)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(found)]):
                    flag[:] = False
                    flag[found[a:b]] = True
                    total += flag
        total[BUCKETS] = seen  # the number of documents
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = rows.select("_kw_text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1)
    for r in counted.collect():  # one row per bucket
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    short = F.length("_kw_text") <= max_chars
    per = {r["_kw_lang"]: (r["short"], r["n"]) for r in rows.groupBy("_kw_lang").agg(
        F.sum(short.cast("long")).alias("short"), F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(per)
    if not names:
        return {"names": []}
    quota = max(1, most // len(names))
    few = [k for k in names if per[k][0] < min(quota, per[k][1])]  # their whole long texts are drawn from too
    width = 1 << 30
    limits = F.create_map(*[x for k in names for x in (
        F.lit(k), F.lit(min(width, int(1.1 * width * quota / per[k][k in few]) + 1)))])
    drawn = rows.where(short | F.col("_kw_lang").isin(few)).where(F.pmod(F.col("_kw_hash"), F.lit(width)) < limits[F.col("_kw_lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(ngrams([t])[0], return_counts=True) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(2), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()),
                pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], names=["lang", "h", "f", "c"])

    drawn = settle(drawn.mapInArrow(features, "lang string, h long, f binary, c binary"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))  # some 1.1 quotas per language
    sample = drawn.withColumn("place", place).where(F.col("place") <= quota).orderBy(F.xxhash64("h"), "h", "lang").collect()
    code = {k: i for i, k in enumerate(names)}
    used, held = [], []
    for r in sample:
        at, count = np.frombuffer(r["f"], "<i4"), np.frombuffer(r["c"], "<i4")
        at, count = at[at < BUCKETS].astype(np.int64), count[at < BUCKETS]
        x = SCALE * count / max(1, count.sum()) * idf[at]
        # Every fifth text of a language calibrates; the constant is a feature of its own.
        (held if r["place"] % 5 == 0 else used).append((np.append(at, BUCKETS), np.append(x, 1.0), code[r["lang"]]))
    w = ftrl(used, len(names), BUCKETS + 1)
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(names))
    heat = temperature(logits, np.array([y for *_, y in held], np.int64))
    return {"names": names, "weights": (SCALE * w[:BUCKETS] * idf[:, None] / heat).astype(np.float32),
            "constant": w[BUCKETS] / heat, "temperature": heat}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and lang_score, the calibrated probability of the predicted language.

    Null texts and texts without a letter are `und` with score 0, as is every text
    if no language was learned; ties go to the first name.  Whole texts are read;
    repeated rows stay; columns of `docs` named like the two new ones are
    replaced; an empty table gives an empty one.  The model, of fixed size, is
    broadcast.
    """
    docs = docs.drop("lang_pred", "lang_score")
    if not model["names"]:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, constant = shared.value["names"], shared.value["constant"]
        weights = np.concatenate([shared.value["weights"], np.zeros((1, len(names)), np.float32)])
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, part in sliced(batch, SLICE):
                found, starts, letters = ngrams(part)
                n = np.add.reduceat((found < BUCKETS).astype(np.int64), starts)
                sums = np.stack([np.add.reduceat(weights[:, k][found], starts, dtype=np.float64) for k in range(len(names))], 1)
                logits = sums / np.maximum(n, 1)[:, None] + constant
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for row, (b, some) in enumerate(zip(best.tolist(), (letters > 0).tolist())):
                    langs.append(names[b] if some else UNKNOWN)
                    scores.append(float(p[row, b]) if some else 0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return docs.withColumn("_kw_l", run(F.col(text))).select(
        *docs.columns, F.col("_kw_l.lang").alias("lang_pred"), F.col("_kw_l.score").alias("lang_score"))
