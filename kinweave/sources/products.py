"""Tables and files of what the jobs produce.

Files are laid out with the `rebalance` hint: small partitions are merged and
large ones split at run time, so a project with most of the rows is written by
many tasks and small projects do not leave thousands of files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.schemas import COUNT_FEATURES, PANEL_COLUMNS, TRIAL_COLUMNS
from kinweave.sources import store

TECH_EDGE = "project string, file string, dev string, weight long, month int"
SOCIAL_EDGE = "project string, src string, dst string, weight long, month int"
TRIALS = ", ".join(
    f"{c} {'double' if c == 'perf' else 'long' if c == 'support' else 'string'}" for c in TRIAL_COLUMNS)


def panel_schema() -> T.StructType:
    kind = lambda c: (
        T.StringType() if c == "proj_name" else T.IntegerType() if c == "month"
        else T.LongType() if c in COUNT_FEATURES else T.DoubleType())
    return T.StructType([T.StructField(c, kind(c)) for c in PANEL_COLUMNS])


def _read(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """The stored table, or an empty one where nothing is stored yet."""
    try:
        return spark.read.format(fmt).options(**options).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_slices(rows: DataFrame, path: str, start: int = 0, author: str = "dev",
                 by: tuple[str, ...] = ("month",)) -> None:
    """Monthly slices, month numbers less `start`; rows without author left out.

    Folders are by month, which the calendar bounds, and rows sorted by project,
    so a (project, month) slice is a folder plus a range of its files.  `by` may
    name the project too where there are few.
    """
    kept = rows.where(F.col(author).isNotNull()).withColumn("month", F.col("month") - start)
    kept.hint("rebalance", *by).sortWithinPartitions("month", "project").write.mode("overwrite").partitionBy(
        *by).parquet(path)


def write_edges(edges: DataFrame, path: str, by: tuple[str, ...] = ("month",)) -> None:
    """`##`-separated text with the project in front, one folder per month."""
    ends = ["file", "dev"] if "file" in edges.columns else ["src", "dst"]
    lines = edges.select("project", *ends, "weight", "month")
    lines.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).csv(path, sep="##")


def read_edges(spark: SparkSession, path: str, kind: str = "tech") -> DataFrame:
    """Edges from such text; a missing folder is an empty graph."""
    schema = TECH_EDGE if kind == "tech" else SOCIAL_EDGE
    return _read(spark, path, schema, "csv", sep="##")


def write_interactions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_panel(panel: DataFrame, path: str, incubator: str, options: str, version: str) -> None:
    """The panel under its incubator, option string and version; other versions stay."""
    keyed = panel.withColumns({"incubator": F.lit(incubator), "options": F.lit(options), "version": F.lit(version)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "incubator", "options", "version").parquet(path)


def read_panel(spark: SparkSession, path: str, incubator: str, options: str, version: str, build=None) -> DataFrame:
    """A stored panel; where it is absent, `build(clean panel)` makes and stores it."""
    schema = T.StructType(panel_schema().fields + [
        T.StructField(c, T.StringType()) for c in ("incubator", "options", "version")])
    stored = _read(spark, path, schema)
    at = lambda o: stored.where(
        (F.col("incubator") == incubator) & (F.col("options") == o) & (F.col("version") == version)
    ).drop("incubator", "options", "version")
    found = at(options)
    if build is None or not found.isEmpty():
        return found
    write_panel(build(at("clean")), path, incubator, options, version)
    return read_panel(spark, path, incubator, options, version)


def load_cached(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """The cached panel rows of one project, from its bucket, or of all; empty without a cache."""
    key = {} if project is None else {"proj_name": project}
    return store.load(spark, path, panel_schema(), **key)


def save_cached(rows: DataFrame, path: str, **layout: int) -> None:
    """Replace the cached rows of the projects in `rows`; other projects stay.

    Projects share buckets, whose number follows the size of the cache; only
    touched ones are read and written.
    """
    kinds = panel_schema()
    store.save(rows.select(*[F.col(c).cast(kinds[c].dataType) for c in PANEL_COLUMNS]), path, ["proj_name"], **layout)


def write_products(products: dict[str, DataFrame], path: str, key: str = "project", number: int | None = None,
                   **layout: int) -> None:
    """Every product as JSON lines in the store `<path>/<name>`.

    The rows of the projects in a product replace those saved before; all other
    projects stay, also those of the same bucket.  `number` is that of a batch
    that may be run again.
    """
    for name, rows in products.items():
        store.save(rows, f"{path.rstrip('/')}/{name}", [key], "json", number, **layout)


def read_product(spark: SparkSession, path: str, name: str, schema: T.StructType | str, **key: object) -> DataFrame:
    """A saved product of all projects, or of one (`project=...`); empty where none is saved."""
    return store.load(spark, f"{path.rstrip('/')}/{name}", schema, "json", **key)


def load_trials(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The trial store; empty where none exists."""
    return _read(spark, path, TRIALS, fmt, **({"header": "true"} if fmt == "csv" else {}))


def export_trials(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to the trial store."""
    writer = rows.select(*TRIAL_COLUMNS).write.mode("append")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_forecast(forecast: DataFrame, path: str, **layout: int) -> None:
    """`project, month, close` lines in buckets of projects; the projects of `forecast` replace their lines, others stay."""
    store.save(forecast.select("project", "month", F.col("p").alias("close")), path, ["project"], "csv", **layout)


def read_forecast(spark: SparkSession, path: str, **key: object) -> DataFrame:
    return store.load(spark, path, "project string, month int, close double", "csv", **key)
