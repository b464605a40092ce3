"""Lookup tables kept as JSON objects.

A path is one file with one object, as the tables are handed in, or a folder of
objects, as `save_objects` writes them: keys are dealt to buckets by a hash, each
bucket is one object, and loading reads the objects of all files side by side.  An
object is parsed as one value and exploded, and from then on is an ordinary table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys of one object.
BUCKET_ROWS = 10_000


def _object(spark: SparkSession, path: str, kind: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", kind).alias("o"))


def load_status(spark: SparkSession, path: str) -> DataFrame:
    """{status: [project]} as (project, status)."""
    rows = _object(spark, path, "map<string,array<string>>").select(F.explode("o").alias("status", "names"))
    return rows.select(F.explode("names").alias("project"), "status")


def load_lengths(spark: SparkSession, path: str) -> DataFrame:
    """{project: months} as (project, months)."""
    return _object(spark, path, "map<string,int>").select(F.explode("o").alias("project", "months"))


def load_starts(spark: SparkSession, path: str) -> DataFrame:
    """{project: timestamp text} as (project, start)."""
    rows = _object(spark, path, "map<string,string>").select(F.explode("o").alias("project", "_t"))
    return rows.select("project", F.to_timestamp("_t").alias("start"))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """{project: {alias: name}} as (project, name, full_name)."""
    rows = _object(spark, path, "map<string,map<string,string>>").select(F.explode("o").alias("project", "m"))
    return rows.select("project", F.explode("m").alias("name", "full_name"))


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """{project: [[name]]} as (project, cluster, name); the first name names the cluster."""
    rows = _object(spark, path, "map<string,array<array<string>>>").select(F.explode("o").alias("project", "c"))
    rows = rows.select("project", F.explode("c").alias("names"))
    return rows.select("project", F.array_min("names").alias("cluster"), F.explode("names").alias("name"))


def load_ratios(spark: SparkSession, path: str, profile: str) -> dict[str, float]:
    """Lifecycle ratio of each incubator under a profile; one entry per incubator."""
    kind = "map<string,map<string,struct<ratio:double,tech:double,social:double>>>"
    rows = _object(spark, path, kind).select(F.explode(F.col("o")[profile]).alias("incubator", "r"))
    return {r["incubator"]: r["ratio"] for r in rows.select("incubator", "r.ratio").collect()}


def load_bot_names(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(name parts, whole names) that mark automatic accounts."""
    rows = _object(spark, path, "map<string,array<string>>").select(F.explode("o").alias("kind", "names"))
    lists: dict[str, list[str]] = {}
    for r in rows.select("kind", F.explode("names").alias("name")).distinct().collect():
        lists.setdefault(r["kind"], []).append(r["name"])
    return sorted(lists.get("substring-bots", [])), sorted(lists.get("project-bots", []))


def load_extensions(spark: SparkSession, path: str) -> list[str]:
    """Extensions of the languages that are typed programming or markup."""
    rows = spark.read.json(path, schema="type string, extensions array<string>", multiLine=True)
    kept = rows.where(F.col("type").isin("programming", "markup")).select(F.explode("extensions").alias("e"))
    return sorted(r["e"] for r in kept.distinct().collect())


def save_objects(rows: DataFrame, path: str, key: str, value: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """One JSON object {key: value} per bucket of about `bucket_rows` keys; keys are not null and do not repeat."""
    buckets = max(1, -(-rows.count() // bucket_rows))
    object_of = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    _write_objects(rows.groupBy(bucket).agg(object_of.alias("value")), path)


def save_lists(rows: DataFrame, path: str, key: str, value: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """JSON objects {key: [values]}; a key with many values stands in several objects."""
    buckets = max(1, -(-rows.count() // bucket_rows))
    part = F.pmod(F.xxhash64(value), F.lit(buckets)).alias("bucket")
    lists = rows.groupBy(part, key).agg(F.collect_list(value).alias("names"))
    object_of = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), "names"))))
    _write_objects(lists.groupBy("bucket").agg(object_of.alias("value")), path)


def save_maps(rows: DataFrame, path: str, key: str, name: str, value: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """JSON objects {key: {name: value}}; a key with many names stands in several objects."""
    buckets = max(1, -(-rows.count() // bucket_rows))
    part = F.pmod(F.xxhash64(key, name), F.lit(buckets)).alias("bucket")
    maps = rows.groupBy(part, key).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("names"))
    object_of = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), "names"))))
    _write_objects(maps.groupBy("bucket").agg(object_of.alias("value")), path)


def _write_objects(objects: DataFrame, path: str) -> None:
    objects.select("bucket", "value").write.mode("overwrite").partitionBy("bucket").option("lineSep", "\n").text(path)
