"""The same work fed by streams.

Sinks write one folder per micro-batch and overwrite it when a batch is run
again, so a batch repeated after a failure changes nothing.  Readers take the
latest batch of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import cleaning, edges


def read_log_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                    files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_edges(log: DataFrame, watermark: str = "31 days") -> DataFrame:
    """Running touches per (project, day, file, developer).

    Windows have no month unit, and state is dropped only for windows the
    watermark has passed; days are such windows and add up to months exactly.
    """
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "project", "file", "dev")
        .agg(F.count(F.lit(1)).alias("weight"))
        .select("project", F.to_date("w.start").alias("day"), "file", "dev", "weight")
    )


def stream_activity(log: DataFrame, watermark: str = "31 days") -> DataFrame:
    """Running messages per (project, day, sender); its keys are the active people."""
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "project", "dev")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select("project", F.to_date("w.start").alias("day"), "dev", "messages")
    )


def upsert(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of changed keys under its number; ends when the input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value of each key of an upserted table."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")


def monthly_edges(daily: DataFrame) -> DataFrame:
    """Daily touches summed to calendar months."""
    return daily.groupBy(
        "project", cleaning.month_index("day").alias("month"), "file", "dev"
    ).agg(F.sum("weight").alias("weight"))


def active_people(daily: DataFrame) -> DataFrame:
    """People and messages per project and day."""
    return daily.groupBy("project", "day").agg(
        F.count(F.lit(1)).alias("people"), F.sum("messages").alias("messages"))


def ingest_social(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the social graphs up to date: each batch rebuilds only the months it touches.

    Raw rows are stored by month, so reading a touched month back is a
    partition-pruned scan; graphs are stored per batch and the latest counts.
    """
    log_path, graph_path = f"{path}/log", f"{path}/graph"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(log_path)
        stored = spark.read.parquet(log_path).where(F.col("batch") <= number)
        touched = stored.where(F.col("batch") == number).select("project", "month").distinct()
        rows = stored.join(touched, ["project", "month"], "left_semi").drop("batch")
        graph = edges.social_graph(cleaning.infer_replies(rows, guarded=False))
        graph.write.mode("overwrite").parquet(f"{graph_path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_graph(spark: SparkSession, path: str) -> DataFrame:
    """The graph of each (project, month) from the last batch that touched it."""
    rows = spark.read.option("basePath", f"{path}/graph").parquet(f"{path}/graph")
    last = rows.groupBy("project", "month").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["project", "month", "batch"], "left_semi").drop("batch")
