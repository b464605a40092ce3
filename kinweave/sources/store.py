"""A table replaced by key: rows in hash buckets, merged on write.

A save reads the buckets its keys fall in, puts the new rows in the place of those
with the same keys, keeps all others, and writes these buckets under a number of
its own: `<path>/save-<number>-<buckets>/bucket=<b>`.  Nothing that readers use is
overwritten: a save counts once its folder has the writer's `_SUCCESS`, so one that
broke off leaves the table as it was, and one that is run again under its number
changes nothing.  Readers take the last complete save of each bucket.  Folders that
the last two states do not use are deleted, and those that have stayed move to
`<path>/base-<buckets>`, so that no listing grows with the number of saves.  One
writer at a time.

A table `by` a column, as a calendar month, has its values for buckets: a save then
touches the months of its rows and no others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import drop_table, settle

#: Buckets of a new table, and rows per bucket from which four times on a Parquet table is dealt to more buckets.
BUCKETS, BUCKET_ROWS = 64, 2_000_000


@dataclass(frozen=True)
class State:
    """The last save, the number of buckets, and the folder that holds each bucket."""

    number: int
    buckets: int
    folders: dict[int, str]


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _saves(spark: SparkSession, path: str) -> list[tuple[int, int, str, list[int]]]:
    """(number, buckets, folder, its buckets) of the base, as number -1, and of the complete saves, in order."""
    out = []
    for name in _children(spark, path):
        if found := re.fullmatch(r"(?:save-(\d+)|base)-(\d+)", name):
            inside = _children(spark, f"{path}/{name}")
            if found[1] is None or "_SUCCESS" in inside:
                held = [int(x.removeprefix("bucket=")) for x in inside if x.startswith("bucket=")]
                out.append((int(found[1] or -1), int(found[2]), f"{path}/{name}", held))
    return sorted(out)


def state(spark: SparkSession, path: str, before: int | None = None) -> State | None:
    """The table as of the last save (below `before`); None where nothing is saved."""
    saves = [s for s in _saves(spark, path) if before is None or s[0] < before]
    if not saves:
        return None
    number, buckets = saves[-1][:2]
    folders = {b: f"{folder}/bucket={b}" for _, k, folder, held in saves if k == buckets for b in held}
    return State(number, buckets, folders)


def _read(spark: SparkSession, folders: list[str], schema: T.StructType, fmt: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    options = {"header": "true"} if fmt == "csv" else {}
    return spark.read.format(fmt).schema(schema).options(**options).load(folders)


def _bucket(keys: list[str], buckets: int, by: str | None = None):
    return F.col(by).cast("int") if by else F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **key: object) -> DataFrame:
    """All rows, or those of one `key` (all key columns by name, as saved), read from its bucket alone.

    Nothing saved yet is an empty table.  `load_buckets` reads some buckets of a
    table that has a column's values for buckets.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    now = state(spark, path.rstrip("/"))
    if now is None:
        return spark.createDataFrame([], schema)
    if not key:
        return _read(spark, list(now.folders.values()), schema, fmt)
    literals = [F.lit(v).cast(schema[c].dataType) for c, v in key.items()]
    b = spark.range(1).select(F.pmod(F.xxhash64(*literals), F.lit(now.buckets)).cast("int")).first()[0]
    rows = _read(spark, [now.folders[b]] if b in now.folders else [], schema, fmt)
    for c, v in zip(key, literals):
        rows = rows.where(F.col(c).eqNullSafe(v))
    return rows


def load_buckets(spark: SparkSession, path: str, schema: T.StructType | str, values: list[int]) -> DataFrame:
    """The rows whose `by` column has one of `values`; no other folder is read."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    now = state(spark, path.rstrip("/"))
    return _read(spark, [now.folders[v] for v in values if v in now.folders] if now else [], schema, "parquet")


def save(rows: DataFrame, path: str, keys: list[str], fmt: str = "parquet", number: int | None = None,
         buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, by: str | None = None) -> int:
    """Replace the rows of every key in `rows`; rows of other keys stay.  Returns the number of the save.

    With `number`, that of a micro-batch, a repeated save does what it did before;
    a number below the last one is an error.  `buckets` counts for a new table.
    Null keys are keys.  `by` names a key with whole numbers, not null, to take for buckets.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    last = state(spark, path)
    if number is None:
        number = last.number + 1 if last else 0
    elif last and number < last.number:
        raise ValueError(f"save {number} comes after save {last.number}")
    before = state(spark, path, number)
    buckets = 0 if by else before.buckets if before else buckets
    new = settle(rows.withColumn("_bucket", _bucket(keys, buckets, by)))
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # no more than there are buckets
    folders = [before.folders[b] for b in touched if b in before.folders] if before else []
    merged = new
    if folders:
        old = _read(spark, folders, rows.schema, fmt)
        gone = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        same = [old[k].eqNullSafe(gone[f"_k{i}"]) for i, k in enumerate(keys)]
        kept = old.join(gone, same, "left_anti").withColumn("_bucket", _bucket(keys, buckets, by))
        merged = kept.unionByName(new)
    _write(merged, f"{path}/save-{number:08d}-{buckets}", fmt)
    drop_table(new)
    if fmt == "parquet" and not by:
        now = state(spark, path)
        total = _read(spark, list(now.folders.values()), rows.schema, fmt).count()  # from the footers
        if total > 4 * bucket_rows * buckets:
            number += 1
            buckets = -(-total // bucket_rows)
            every = _read(spark, list(now.folders.values()), rows.schema, fmt)
            _write(every.withColumn("_bucket", _bucket(keys, buckets, by)), f"{path}/save-{number:08d}-{buckets}", fmt)
    _clean(spark, path, number)
    return number


def _write(rows: DataFrame, folder: str, fmt: str) -> None:
    laid = rows.withColumnRenamed("_bucket", "bucket").hint("rebalance", "bucket")
    options = {"header": "true"} if fmt == "csv" else {}
    laid.write.format(fmt).options(**options).mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").save(folder)


def _clean(spark: SparkSession, path: str, number: int) -> None:
    """Delete bucket folders of neither this state nor the one before, which a repeated save reads; move the older ones to the base."""
    here, past = state(spark, path), state(spark, path, number)
    used = {f for s in (here, past) if s for f in s.folders.values()}
    fs, base = _system(spark, f"{path}/base-{here.buckets}")
    at = spark._jvm.org.apache.hadoop.fs.Path
    for n, k, folder, held in _saves(spark, path):
        stay = [b for b in held if f"{folder}/bucket={b}" in used]
        for b in set(held) - set(stay):
            fs.delete(at(f"{folder}/bucket={b}"), True)
        if 0 <= n < (past.number if past else 0) and k == here.buckets:
            fs.mkdirs(base)
            for b in stay:  # the base holds an older state of the bucket, if any, and that is deleted by now
                fs.rename(at(f"{folder}/bucket={b}"), at(f"{path}/base-{k}/bucket={b}"))
            stay = []
        if n < number and n != (past.number if past else None) and not stay and folder != f"{path}/base-{here.buckets}":
            fs.delete(at(folder), True)
