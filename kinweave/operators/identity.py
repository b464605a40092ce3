"""Merging the names one person uses.

Pairs are looked for among the distinct name keys of a project.  A
Jaro-Winkler score above `least` bounds the number of characters two keys must
share from below: c of the a and b characters, with c known from the lengths and
from how many first letters are equal.  In an order from rare to frequent, the
first a - c + k and b - c + k characters of such keys share k (the k-prefix of set
joins), so keys meet in the choices of k characters: an equi-join on (project,
equal first letters, choice) with no name left out and no all-pairs step.  The join
itself counts what a pair shares, in the key and in both words of two-word names,
from bits carried along, so that few pairs leave it.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.functions.similarity import (
    BOOST_FROM, PREFIX_LENGTH, PREFIX_WEIGHT, jaro_winkler_rows, segment_compatible, segments_agree_rows, similarity,
)
from kinweave.operators.components import connected_components
from kinweave.operators.peeling import refine_large
from kinweave.operators.skew import lookup
from kinweave.schemas import Logs
from kinweave.session import settle, ship_functions

ship_functions(__name__)

# Fixed value: letters from rare to frequent; any fixed order gives the same pairs.
RARE_FIRST = "QXZJKVUYWIFONHEGLTPRDBCSAMzqxjkvbpygfwmucldrhsnioate "

# Characters of a choice by the number of equal first letters, at most, and choices of one key, about at most.
CHOICE, CHOICES = (8, 4, 2, 1, 1), 170
# Uses of a letter that have a bit of their own; a pair's further uses count as shared.
USES, WORD_USES = 3, 2
# Names of a cluster that is refined in one task, at most.
LARGE = 4000


def person_universe(tech: DataFrame, social: DataFrame, source: str = "sender") -> DataFrame:
    """Distinct names of people per project, for projects that appear in both logs."""
    name = F.col(source)
    usable = name.isNotNull() & (name != "none") & (F.col("is_bot") == 0)
    t = tech.where(usable & (F.col("is_coding") == 1)).select("project", name.alias("name")).distinct()
    s = social.where(usable).select("project", name.alias("name")).distinct()
    both = (
        t.withColumn("_t", F.lit(1)).withColumn("_s", F.lit(0))
        .unionByName(s.withColumn("_t", F.lit(0)).withColumn("_s", F.lit(1)))
    )
    seen = both.groupBy("project").agg(
        F.max("_t").alias("_pt"), F.max("_s").alias("_ps"), F.count(F.lit(1)).alias("_n"))
    names = lookup(both.select("project", "name").distinct(), seen, ["project"], "_n")
    return names.where("_pt = 1 AND _ps = 1").select("project", "name")


def normalise(persons: DataFrame) -> DataFrame:
    return persons.withColumn("key", text.person_key(F.col("name")))


def _letters(word: str) -> list[int]:
    """The characters as distinct numbers (character, n-th use), rare ones first."""
    used: dict[str, int] = {}
    out = []
    for c in word:
        used[c] = used.get(c, 0) + 1
        out.append((1000 - used[c]) * 100 + RARE_FIRST.index(c))
    return sorted(out)


def _bits(letters: list[int], uses: int) -> list[int]:
    """A word of bits for the first uses of the letters, one for the second, and so on; last the number of uses beyond."""
    out = [0] * (uses + 1)
    for x in letters:
        use = 1000 - x // 100
        if use > uses:
            out[uses] += 1
        else:
            out[use - 1] |= 1 << x % 100
    return out


def _added(rows: DataFrame, columns: list[str], values) -> DataFrame:
    """The rows with whole-number columns, and `choices` if named, that `values` makes of a key."""
    kinds = [pa.list_(pa.int64()) if c == "choices" else pa.int64() for c in columns]

    def add(batches):
        for batch in batches:
            found = [values(x) for x in batch.column("key").to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *columns])

    spec = [f"{c} {t}" for c, t in rows.dtypes] + [f"{c} {'array<long>' if c == 'choices' else 'long'}" for c in columns]
    return rows.mapInArrow(add, ", ".join(spec))


def _shared(a: int, b: int, need: float) -> int:
    """Fewest characters keys of lengths a and b must share (m/a + m/b > need)."""
    return math.floor(need * a * b / (a + b) - 1e-9) + 1


def length_options(lengths: list[int], equal: int, need: float) -> list[tuple[int, int, int, int]]:
    """(la, lb, rest, k): lengths of keys with `equal` equal first letters that can match, the
    characters they share beside those, and how many of them a choice has."""
    out = []
    for x, a in enumerate(lengths):
        if a < equal:
            continue
        for b in lengths[x:]:
            shared = _shared(a, b, need)
            if shared > a:
                break
            rest = max(0, shared - equal)
            k = min(rest, CHOICE[equal])
            while k > 1 and math.comb(b - equal - rest + k, k) > CHOICES:
                k -= 1
            out.append((a, b, rest, k))
    return out


def choice_options(options: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(length, k, rest): for a key of this length, the least `rest` of all pairs of lengths that meet in choices of k."""
    least: dict[tuple[int, int], int] = {}
    for a, b, rest, k in options:
        for length in (a, b):
            least[length, k] = min(rest, least.get((length, k), rest))
    return [(length, k, rest) for (length, k), rest in least.items()]


def _most_shared(name: str, uses: int) -> Column:
    """How many letters a pair can share, from the bits of both; not fewer than it does."""
    both = [F.bit_count(F.col(f"a.{name}{n}").bitwiseAND(F.col(f"b.{name}{n}"))) for n in range(uses)]
    return sum(both, F.least(f"a.{name}{uses}", f"b.{name}{uses}"))


def _word_may_agree(number: int, equal: Column) -> Column:
    """False only for words that score below 0.8 with `equal` equal first letters, by the letters they share."""
    score = F.greatest(1 - 0.2 / (1 - PREFIX_WEIGHT * equal), F.lit(BOOST_FROM))
    a, b = F.col(f"a.size{number}"), F.col(f"b.size{number}")
    return _most_shared(f"word{number}_", WORD_USES) * (a + b) >= (3 * score - 1) * a * b - 1e-6


def _candidates(keys: DataFrame, equal: int, need: float, options: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Pairs with `equal` equal first letters (just so many, unless all that count) and enough shared characters."""
    def of(key: str) -> list:
        letters = _letters(key[equal:])
        # The hash of a tuple of whole numbers is the same in every process.
        chosen = [hash(x) for k, rest in options.get(len(key), [])
                  for x in combinations(letters[:max(len(letters) - rest + k, 0)], k)]
        return [ord(key[equal]) if len(key) > equal else 0, *_bits(letters, USES), chosen]

    names = ["next", *[f"bits{n}" for n in range(USES + 1)], "choices"]
    rows = _added(keys.where(F.col("len") >= equal), names, of).withColumn("head", F.left("key", F.lit(equal)))
    rows = rows.withColumn("choice", F.explode("choices")).withColumn(
        "at", F.xxhash64("project", "head", "choice")).drop("choices", "choice")
    a, b = rows.alias("a"), rows.alias("b")
    la, lb = F.col("a.len"), F.col("b.len")
    enough = _most_shared("bits", USES) + equal > F.floor(F.lit(need) * la * lb / (la + lb) - 1e-9)
    first = F.when(F.col("a.first2") == F.col("b.first2"), F.lit(PREFIX_LENGTH)).otherwise(F.lit(0))
    words = (F.col("a.size1") == 0) | (F.col("b.size1") == 0) | (
        _word_may_agree(1, F.lit(equal)) & _word_may_agree(2, first))
    met = (F.col("a.at") == F.col("b.at")) & enough & words
    if equal < PREFIX_LENGTH:
        met &= F.col("a.next") != F.col("b.next")
    for c in ("head", "project"):
        met &= F.col(f"a.{c}") == F.col(f"b.{c}")
    # The size that is planned with knows nothing of the choices, so a broadcast is never right here.
    return a.join(b.hint("merge"), met & (F.col("a.key") < F.col("b.key"))).select(
        "a.project", F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def candidate_pairs(persons: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs of name keys of a project that share enough characters to score above `least`, both words of two-word
    names enough to agree.

    Every pair is looked for in the case of its equal first letters, 0 to 4,
    because the score's bonus for them lowers what the rest must share.
    """
    if least < 0.82:
        raise ValueError("the letter bounds hold for thresholds of at least 0.82")

    def need(equal: int) -> float:
        return 3 * (1 - (1 - least) / (1 - PREFIX_WEIGHT * equal)) - 1

    keys = normalise(persons).select("project", "key").where("key <> ''").distinct().withColumn("len", F.length("key"))

    def words_of(key: str) -> list[int]:
        words = key.split(" ")
        words = words if len(words) == 2 else ["", ""]
        bits = [_bits(_letters(w), WORD_USES) for w in words]
        return [len(words[0]), len(words[1]), ord(words[1][0]) if words[1] else 0, *bits[0], *bits[1]]

    columns = ["size1", "size2", "first2", *[f"word{n}_{i}" for n in (1, 2) for i in range(WORD_USES + 1)]]
    tasks = int(persons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = settle(_added(keys.repartition(tasks), columns, words_of))
    lengths = sorted(r["len"] for r in keys.select("len").distinct().collect())
    found = None
    for equal in range(PREFIX_LENGTH + 1):
        options: dict[int, list[tuple[int, int]]] = {}
        for length, k, rest in choice_options(length_options(lengths, equal, need(equal))):
            options.setdefault(length, []).append((k, rest))
        part = _candidates(keys, equal, need(equal), options)
        found = part if found is None else found.unionByName(part)
    return found


def similar_pairs(persons: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs of different name keys of a project that score above `least`."""
    scored = candidate_pairs(persons, least).withColumn("score", similarity("a", "b")).where(F.col("score") > least)
    return scored.where(segment_compatible("a", "b"))


def alias_components(persons: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of two or more names of one person, named by their first name.

    Names with equal keys meet in their key, so no pair among them is formed.
    """
    comps = connected_components(
        pairs.select("project", F.col("a").alias("src"), F.col("b").alias("dst")), ["project"])
    named = normalise(persons.select("project", "name").distinct()).where("key <> ''")
    joined = named.join(
        comps.select("project", F.col("node").alias("key"), "component"), ["project", "key"], "left"
    ).withColumn("component", F.coalesce("component", "key"))
    heads = joined.groupBy("project", "component").agg(
        F.min("name").alias("cluster"), F.count(F.lit(1)).alias("names")).where("names > 1")
    return joined.join(heads, ["project", "component"]).select(
        "project", "cluster", "name", "key", "names")


def _refine(names: pd.DataFrame, least: float, sizes: tuple[int, int]) -> pd.DataFrame:
    """Work is on distinct keys; names of one key score 1 with each other."""
    names = names.sort_values("name").reset_index(drop=True)
    keys, code, times = np.unique(names["key"].to_numpy(object).astype(str), return_inverse=True, return_counts=True)
    column = pa.array(keys, pa.string())
    known: dict[int, np.ndarray] = {}

    def scores(i: int) -> np.ndarray:
        """Scores of a key with all keys; kept for as many as fit in some hundred MB."""
        if i not in known:
            row = jaro_winkler_rows(pa.array([keys[i]] * len(keys)), column)
            row[i] = 1.0
            if len(known) * len(keys) > 20_000_000:
                known.clear()
            known[i] = row
        return known[i]

    left = [sorted(np.flatnonzero(code == i).tolist(), reverse=True) for i in range(len(keys))]
    total = np.array([scores(i) @ times for i in range(len(keys))]) - 1.0
    alive = len(names)
    mean = total / max(alive - 1, 1)
    while alive >= 2:
        mean = np.where([bool(x) for x in left] if alive < len(names) else True, total / max(alive - 1, 1), np.inf)
        low = mean.min()
        if low >= least - 1e-12:
            break
        worst = min(np.flatnonzero(mean <= low + 1e-12).tolist(), key=lambda i: left[i][-1])
        left[worst].pop()
        total = total - scores(worst)
        alive -= 1
    rest = sorted(i for x in left for i in x)
    if not sizes[0] <= len(rest):
        return names.iloc[[]]
    drop = set()
    some = [i for i, x in enumerate(left) if x]
    for x, i in enumerate(some[:-1]):
        others = np.array(some[x + 1:])
        agree = segments_agree_rows(pa.array([keys[i]] * len(others)), column.take(pa.array(others)))
        for j in others[~agree].tolist():
            gone = [i] if mean[i] < mean[j] - 1e-12 else [j] if mean[j] < mean[i] - 1e-12 else [i, j]
            drop |= {n for g in gone for n in left[g]}
    kept = [i for i in rest if i not in drop]
    return names.iloc[kept if sizes[0] <= len(kept) <= sizes[1] else []]


def refine_clusters(
    clusters: DataFrame, least: float = 0.9, sizes: tuple[int, int] = (2, 5), large: int = LARGE,
) -> DataFrame:
    """Drop names that fit their cluster badly and keep clusters of a plausible size.

    Again and again the name with the lowest mean score leaves its cluster, until
    all reach `least`.  A cluster of up to `large` names goes through this in one
    task; the scores of larger ones are taken block by block, and their names
    leave in rounds with the same result.
    """
    columns = "project string, cluster string, name string, key string"

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        return _refine(pdf, least, sizes)

    rows = settle(clusters.select("project", "cluster", "name", "key"))
    counts = rows.groupBy("project", "cluster").agg(F.count(F.lit(1)).alias("rows"))
    hot = settle(counts.where(F.col("rows") > large).withColumn("large", F.lit(True)))
    small = rows
    some = not hot.isEmpty()
    if some:
        marked = lookup(rows, hot, ["project", "cluster"], "rows", settled=True)
        small = marked.where("large IS NULL").drop("large")
        chained = refine_large(marked.where("large").drop("large"), least, sizes)
    kept = small.groupBy("project", "cluster").applyInPandas(refine, columns)
    return kept.unionByName(chained) if some else kept


def canonical_name(clusters: DataFrame) -> DataFrame:
    """The longest two-word name of a cluster, else its longest name, capitalised."""
    regular = F.size(F.split("name", " ")) == 2
    best = clusters.groupBy("project", "cluster").agg(
        F.max_by("name", F.struct(regular.cast("int"), F.length("name"), F.col("name"))).alias("best"))
    return best.select("project", "cluster", text.capitalised(F.col("best")).alias("full_name"))


def alias_map(clusters: DataFrame) -> DataFrame:
    return clusters.join(canonical_name(clusters), ["project", "cluster"]).select(
        "project", "name", "full_name")


def apply_aliases(logs: Logs, aliases: DataFrame, source: str = "sender") -> Logs:
    """Name the author by the alias table, else by the capitalised source name."""
    table = aliases.select("project", F.col("name").alias(source), "full_name")

    def one(df: DataFrame) -> DataFrame:
        df = df.where(F.col(source).isNotNull() & (F.col(source) != "none"))
        for flag, want in (("is_bot", 0), ("is_coding", 1)):
            if flag in df.columns:
                df = df.where(F.col(flag) == want)
        counts = df.groupBy("project", source).agg(F.count(F.lit(1)).alias("_n"))
        named = counts.join(table, ["project", source], "left")
        return (
            lookup(df, named, ["project", source], "_n")
            .withColumn("dev", F.coalesce("full_name", text.capitalised(F.col(source))))
            .drop("full_name")
        )

    return Logs(one(logs.tech), one(logs.social))


def dealias(logs: Logs, least: float = 0.9, sizes: tuple[int, int] = (2, 5), source: str = "sender") -> Logs:
    """The whole chain: people of both logs, similar names, clusters, refinement, one name for each person."""
    people = settle(person_universe(logs.tech, logs.social, source))
    clusters = alias_components(people, similar_pairs(people, least))
    kept = settle(refine_clusters(clusters, least, sizes))
    return apply_aliases(logs, settle(alias_map(kept)), source)
