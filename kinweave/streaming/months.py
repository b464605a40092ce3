"""Daily counts of a stream, of which closed months are summed up once.

A stream with a watermark gives every changed key again with its new value.  Each
batch is written by month below `open`; a month that the watermark has passed can
get no more rows, so it is summed up into `final` and leaves `open`.  A trigger
reads nothing but the months it closes, each of them once, and readers look for
the last value of a key in open months only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import cleaning
from kinweave.sources.store import _children, _system

Finish = Callable[[DataFrame], DataFrame]


def _months(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(x.removeprefix("month=")) for x in _children(spark, folder) if x.startswith("month="))


def _closed(spark: SparkSession, path: str) -> list[int]:
    return [m for m in _months(spark, f"{path}/final") if "_SUCCESS" in _children(spark, f"{path}/final/month={m}")]


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The value of each key in its last batch."""
    values = [c for c in rows.columns if c not in keys and c not in ("batch", "month")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")


def _open(spark: SparkSession, path: str, months: list[int]) -> DataFrame:
    folders = [f"{path}/open/month={m}" for m in months]
    return spark.read.option("basePath", f"{path}/open").parquet(*folders)


def add_batch(batch: DataFrame, number: int, path: str, keys: list[str], finish: Finish, delay_days: int) -> list[int]:
    """Store one batch of changed keys (`keys`, of which one is `day`, and values); returns the months closed by it.

    A batch that is run again does what it did before: it overwrites its own
    folders, and a month that is closed already is left as it is.
    """
    spark = batch.sparkSession
    batch.withColumns({"month": cleaning.month_index("day"), "batch": F.lit(number)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{path}/open")
    seen = f"{path}/seen"
    earlier = [int(x.removeprefix("batch=")) for x in _children(spark, seen) if x.startswith("batch=")]
    before = max((n for n in earlier if n < number), default=None)
    past = spark.read.parquet(f"{seen}/batch={before}").first()["day"] if before is not None else None
    # The watermark of this batch comes from the days of those before it.  Its own last day is read from what is
    # stored: asking the batch once more would run the stream's aggregation again.
    held = [m for m in _months(spark, f"{path}/open") if f"batch={number}" in _children(spark, f"{path}/open/month={m}")]
    if held:
        last = spark.read.parquet(f"{path}/open/month={held[-1]}/batch={number}").agg(F.max("day").alias("day"))
    else:
        last = spark.range(1).select(F.lit(None).cast("date").alias("day"))
    this = last.select(F.greatest("day", F.lit(past).cast("date")).alias("day"))
    this.write.mode("overwrite").parquet(f"{seen}/batch={number}")
    fs, _ = _system(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for n in earlier:
        if before is not None and n < before:
            fs.delete(at(f"{seen}/batch={n}"), True)
    if past is None:
        return []
    edge = spark.range(1).select(cleaning.month_index(F.date_sub(F.lit(past), delay_days)).alias("m")).first()["m"]
    done, over = set(_closed(spark, path)), []
    for month in _months(spark, f"{path}/open"):
        if month < edge:
            if month not in done:
                finish(_last(_open(spark, path, [month]), keys)).write.mode("overwrite").parquet(f"{path}/final/month={month}")
            fs.delete(at(f"{path}/open/month={month}"), True)
            over.append(month)
    return over


def keep_months(rows: DataFrame, path: str, checkpoint: str, keys: list[str], finish: Finish, delay_days: int = 31) -> StreamingQuery:
    """Run `add_batch` on a stream of running counts whose watermark is `delay_days`; ends when the input is used up."""
    return (
        rows.writeStream.outputMode("update").foreachBatch(
            lambda batch, number: add_batch(batch, number, path, keys, finish, delay_days))  # type: ignore[arg-type, return-value]
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def months_so_far(spark: SparkSession, path: str, keys: list[str], finish: Finish) -> DataFrame:
    """All months: closed ones as summed up, open ones from the last value of each key."""
    closed = _closed(spark, path)
    still = [m for m in _months(spark, f"{path}/open") if m not in closed]
    parts = [spark.read.parquet(*[f"{path}/final/month={m}" for m in closed])] if closed else []
    parts += [finish(_last(_open(spark, path, still), keys))] if still else []
    if not parts:
        raise ValueError(f"nothing is stored at {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
