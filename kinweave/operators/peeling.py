"""Refining clusters of names too large for one task.

Scores of names with all others of their cluster are summed by blocks of keys that
meet each other, one row per pair of blocks.  The names with the lowest sums then
leave in rounds.  A task takes the lowest of a cluster and lets them go one after the
other, as if there were no others; every block follows these steps with its own sums
and says before which step one of its names would have been lower; the steps
before that are those of the plain order, and all blocks subtract their scores.

Sums are whole multiples of 1 / `UNIT`: they are exact in any order of adding, and
a task run again decides as before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.similarity import jaro_winkler_rows, segments_agree_rows
from kinweave.operators.skew import lookup
from kinweave.session import drop_table, settle, ship_functions

ship_functions(__name__)

ON = ["project", "cluster"]
#: Keys of a block, about; keys a task may choose from in a round, and half as many steps.
BLOCK, BATCH = 512, 2048
#: Pairs of blocks of a task, about, and tasks at most.
MEETINGS, TASKS = 2, 20_000
UNIT = float(1 << 40)
#: Means that differ by less are equal.
TIE = 1e-12
BLOCKS = "project string, cluster string, block int, blocks int, keys array<string>, left array<array<string>>, total array<long>"


def _grid(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    return (a.take(pa.array(np.repeat(np.arange(len(a)), len(b)))), b.take(pa.array(np.tile(np.arange(len(b)), len(a)))))


def scores(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Score of every key of `a` with every key of `b`, in units; equal keys score one."""
    x, y = _grid(a, b)
    out = np.rint(jaro_winkler_rows(x, y) * UNIT).astype(np.int64).reshape(len(a), len(b))
    left, right = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
    out[left[:, None] == right] = int(UNIT)
    return out


def _blocks(cells: DataFrame, block: int) -> DataFrame:
    """Rows of about `block` keys, dealt out by a hash, from one row per key (project, cluster, key, left, total)."""
    counts = settle(cells.groupBy(*ON).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "blocks", F.ceil(F.col("rows") / F.lit(block)).cast("int")))
    dealt = lookup(cells, counts, ON, "rows").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cell = F.sort_array(F.collect_list(F.struct("key", "left", "total"))).alias("c")
    return dealt.groupBy(*ON, "block", "blocks").agg(cell).select(
        *ON, "block", "blocks", F.col("c.key").alias("keys"), F.col("c.left").alias("left"), F.col("c.total").alias("total"))


def _cells(blocks: DataFrame) -> DataFrame:
    """One row per key."""
    return blocks.select(*ON, F.explode(F.arrays_zip("keys", "left", "total")).alias("c")).select(
        *ON, F.col("c.keys").alias("key"), F.col("c.left").alias("left"), F.col("c.total").alias("total"))


def _meetings(blocks: DataFrame) -> DataFrame:
    """Every two blocks of a cluster once, a block with itself too: an equi-join on the numbers of both."""
    n = blocks.groupBy(*ON).agg(F.max("blocks").alias("n")).agg(F.sum(F.expr("n * (n + 1D) / 2"))).head()[0] or 1
    tasks = int(min(TASKS, max(1, n // MEETINGS)))
    payload = F.struct("keys", F.transform("left", F.size).alias("times"), "total")
    x = blocks.select(*ON, F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), payload.alias("a"))
    y = blocks.select(*ON, F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"), payload.alias("b"))
    on = [*ON, "x", "y"]
    both = x.repartition(tasks, *on).join(y.repartition(tasks, *on).hint("merge"), on)
    return both.select(*on, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("keys", "times", "total")])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each of two blocks adds to the sums of the other's keys."""
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        for r in range(batch.num_rows):
            table = scores(col["a_keys"][r].values, col["b_keys"][r].values)
            same = col["x"][r] == col["y"][r]
            sums = [(col["x"][r].as_py(), table @ col["b_times"][r].values.to_numpy().astype(np.int64))]
            if not same:
                sums.append((col["y"][r].as_py(), col["a_times"][r].values.to_numpy().astype(np.int64) @ table))
            yield pa.RecordBatch.from_pydict({
                "project": [col["project"][r].as_py()] * len(sums), "cluster": [col["cluster"][r].as_py()] * len(sums),
                "block": pa.array([b for b, _ in sums], pa.int32()), "sums": pa.array([s for _, s in sums], pa.list_(pa.int64()))})


def _with_totals(blocks: DataFrame) -> DataFrame:
    """`blocks` with the sum of each key's scores with all names but itself."""
    parts = _meetings(blocks).mapInArrow(_sums, "project string, cluster string, block int, sums array<long>")
    at = parts.select(*ON, "block", F.posexplode("sums").alias("at", "s")).groupBy(*ON, "block", "at").agg(F.sum("s").alias("s"))
    sums = at.groupBy(*ON, "block").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("c"))
    return blocks.drop("total").join(sums, [*ON, "block"]).withColumn(
        "total", F.transform("c", lambda c: c.s - F.lit(int(UNIT)))).drop("c")


def leaving(cells: pd.DataFrame, least: float, steps: int) -> tuple[list[str], list[int]]:
    """The keys of the names that leave, in order, if there were no other keys; and below which sum others come first.

    The first step is always that of the whole cluster: its lowest key is among them.
    """
    cells = cells.sort_values("rank")
    keys, left = pa.array(cells["key"], pa.string()), [list(x) for x in cells["left"]]
    total, alive = cells["total"].to_numpy(np.int64), int(cells["alive"].iloc[0])
    gone: list[str] = []
    bars: list[int] = []
    while alive >= 2 and len(gone) < steps:
        mean = np.where([bool(x) for x in left], total / UNIT / (alive - 1), np.inf)
        low = mean.min()
        if low >= least - TIE:
            break
        worst = min(np.flatnonzero(mean <= low + TIE).tolist(), key=lambda i: left[i][-1])
        left[worst].pop()
        total = total - scores(keys.slice(worst, 1), keys)[0]
        gone.append(keys[worst].as_py())
        bars.append(math.ceil((low + TIE) * (alive - 1) * UNIT))
        alive -= 1
    return gone, bars


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block how many of the steps no key outside the choice would have come before."""
    for batch in batches:
        for row in batch.to_pylist():
            chosen = set(row["chosen"])
            others = [i for i, k in enumerate(row["keys"]) if k not in chosen]
            sound = len(row["gone"])
            if others and sound:
                names, at = np.unique(np.array(row["gone"], object).astype(str), return_inverse=True)
                lost = scores(pa.array([row["keys"][i] for i in others]), pa.array(names, pa.string()))[:, at]
                before = np.cumsum(lost, axis=1) - lost
                ahead = np.array([row["total"][i] for i in others], np.int64)[:, None] - before <= np.array(row["bars"], np.int64)
                first = np.flatnonzero(ahead[:, 1:].any(axis=0))
                sound = int(first[0]) + 1 if len(first) else sound
            yield pa.RecordBatch.from_pydict({
                "project": [row["project"]], "cluster": [row["cluster"]], "sound": pa.array([sound], pa.int32())})


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks less the names that left and their scores; keys without names go."""
    for batch in batches:
        for row in batch.to_pylist():
            times = Counter(row["gone"][: row["sound"]])
            left = [x[: len(x) - times.get(k, 0)] for k, x in zip(row["keys"], row["left"])]
            stay = [i for i, x in enumerate(left) if x]
            lost = scores(pa.array([row["keys"][i] for i in stay], pa.string()), pa.array(list(times), pa.string())) @ np.array(list(times.values()), np.int64)
            yield pa.RecordBatch.from_pydict({
                "project": [row["project"]], "cluster": [row["cluster"]],
                "block": pa.array([row["block"]], pa.int32()), "blocks": pa.array([row["blocks"]], pa.int32()),
                "keys": pa.array([[row["keys"][i] for i in stay]], pa.list_(pa.string())),
                "left": pa.array([[left[i] for i in stay]], pa.list_(pa.list_(pa.string()))),
                "total": pa.array([[row["total"][i] - int(x) for i, x in zip(stay, lost)]], pa.list_(pa.int64()))})


def _peeled(state: DataFrame, least: float, batch: int) -> DataFrame:
    """One row per key that is left when all names of its cluster reach `least` on average."""
    finished = _cells(state).limit(0).withColumn("alive", F.lit(0).cast("long"))
    tables = [state]
    tasks = int(min(TASKS, max(1, state.count())))  # a block is some seconds of work in a round
    while True:
        cells = _cells(state)
        sums = cells.groupBy(*ON).agg(
            F.min("total").alias("least"), F.sum(F.size("left")).alias("alive"), F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("n"))
        fits = (F.col("alive") < 2) | (F.col("least") / F.lit(UNIT) / (F.col("alive") - 1) >= F.lit(least - TIE))
        heads = settle(sums.withColumn("fits", fits))
        known = lookup(cells, heads, ON, "rows", settled=True)
        done, going = heads.agg(F.count_if(F.col("fits")), F.count_if(~F.col("fits"))).head()
        if done:
            finished = finished.unionByName(known.where("fits").select(*ON, "key", "left", "total", "alive"))
        if not going:
            finished = settle(finished)
            for t in tables:
                drop_table(t)
            return finished
        # Equal sums, to a rounding, go in the order of their next name.
        tied = F.col("total") <= F.col("least") + F.lit(TIE * UNIT) * (F.col("alive") - 1)
        low = F.when(tied, F.col("least")).otherwise(F.col("total"))
        order = Window.partitionBy(*ON).orderBy("low", F.element_at("left", -1))
        chosen = known.where("not fits").withColumn("low", low).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= batch)

        def leave(pdf: pd.DataFrame) -> pd.DataFrame:
            gone, bars = leaving(pdf, least, max(1, batch // 2))
            return pd.DataFrame({"project": pdf["project"].iloc[:1], "cluster": pdf["cluster"].iloc[:1], "rows": pdf["rows"].iloc[:1],
                                 "chosen": [list(pdf["key"])], "gone": [gone], "bars": [bars]})

        steps = settle(chosen.withColumnRenamed("n", "rows").groupBy(*ON).applyInPandas(
            leave, "project string, cluster string, rows long, chosen array<string>, gone array<string>, bars array<long>"))
        # One row per block: the steps are read once for some hundred keys.
        dealt = state.repartition(tasks, *ON, "block")
        followed = lookup(dealt, steps, ON, "rows", settled=True).where("gone IS NOT NULL")
        sound = settle(followed.mapInArrow(_sound, "project string, cluster string, sound int").groupBy(*ON).agg(F.min("sound").alias("sound")))
        valid = steps.drop("chosen", "bars").join(sound, ON)
        state = settle(lookup(dealt, valid, ON, "rows").where("gone IS NOT NULL").mapInArrow(_without, BLOCKS).where("size(keys) > 0"))
        tables.append(state)


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys whose first or last words differ from those of a key that fits as well or better."""
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        for r in range(batch.num_rows):
            a, b = col["a_keys"][r].values, col["b_keys"][r].values
            x, y = _grid(a, b)
            bad = ~segments_agree_rows(x, y).reshape(len(a), len(b))
            # Sums over the same number of others, in units: the tolerance of the means times that number.
            others = max(col["alive"][r].as_py() - 1, 1)
            ahead = (col["a_total"][r].values.to_numpy()[:, None] - col["b_total"][r].values.to_numpy()) / UNIT / others
            drop = [*a.take(pa.array(np.flatnonzero((bad & (ahead <= TIE)).any(axis=1)))).to_pylist(),
                    *b.take(pa.array(np.flatnonzero((bad & (-ahead <= TIE)).any(axis=0)))).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "project": pa.array([col["project"][r].as_py()] * len(drop), pa.string()),
                "cluster": pa.array([col["cluster"][r].as_py()] * len(drop), pa.string()), "key": pa.array(drop, pa.string())})


def refine_large(clusters: DataFrame, least: float, sizes: tuple[int, int], block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """(project, cluster, name, key) of what stays of large clusters: the result of the plain order, name by name.

    Work is on distinct keys, of which one has all its names in a row.  No task
    holds more than a few blocks or one choice of `batch` keys; the scores taken
    are those of all pairs of keys once, and again of those that leave.
    """
    cells = clusters.groupBy(*ON, "key").agg(F.sort_array(F.collect_list("name"), asc=False).alias("left")).withColumn(
        "total", F.lit(0).cast("long"))
    start = settle(_blocks(cells, block))
    rest = _peeled(settle(_with_totals(start)), least, batch)
    drop_table(start)
    alive = settle(rest.groupBy(*ON).agg(F.max("alive").alias("alive"), F.count(F.lit(1)).alias("rows")).where(F.col("alive") >= sizes[0]))
    enough = settle(lookup(rest.drop("alive"), alive, ON, "rows", settled=True).where("alive IS NOT NULL"))
    blocks = settle(_blocks(enough.drop("alive"), block))
    met = lookup(_meetings(blocks), alive, ON, "rows", settled=True)
    unlike = met.mapInArrow(_unlike, "project string, cluster string, key string").distinct()
    kept = settle(enough.join(unlike, [*ON, "key"], "left_anti"))
    counts = settle(kept.groupBy(*ON).agg(F.sum(F.size("left")).alias("names"), F.count(F.lit(1)).alias("rows")))
    fitting = lookup(kept, counts, ON, "rows", settled=True).where(F.col("names").between(*sizes))
    return fitting.select(*ON, F.explode("left").alias("name"), "key")
