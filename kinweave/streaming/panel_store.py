"""Both graphs and the panel, kept up to date by batches of log rows.

A batch rebuilds the graphs of the (project, month) slices it has rows of, from the
stored rows of these months, and then the panel rows of these months and the
next ones, whose overlap looks back.  Graphs and panel rows are replaced by key in
stores with a folder per month; nothing else is read or written, whatever was
stored before.  Batches may be late, and run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import cleaning, edges, panel
from kinweave.schemas import COUNT_FEATURES, FEATURES
from kinweave.session import drop_table, settle
from kinweave.sources import store
from kinweave.sources.products import SOCIAL_EDGE, TECH_EDGE

SLICE = ["project", "month"]
#: Rows of a batch that a task sorts by month and writes, about.
WRITE_ROWS = 1_000_000
#: Columns of the incoming rows; `kind` is tech or social, `month` the calendar month is added.
LOG = ("kind string, project string, ts timestamp, dev string, is_bot int, file string, is_coding int, "
       "subject string, message_id string")
PANEL = "project string, month int, has_tech boolean, " + ", ".join(
    f"{c} {'long' if c in COUNT_FEATURES else 'double'}" for c in FEATURES)


def as_rows(tech: DataFrame, social: DataFrame) -> DataFrame:
    """Both logs (with dev and flags) as the rows of one stream."""
    names = [c.split()[0] for c in LOG.split(", ")]
    kinds = dict(c.split() for c in LOG.split(", "))

    def full(log: DataFrame, kind: str) -> DataFrame:
        log = log.withColumn("kind", F.lit(kind))
        return log.select(*[(F.col(c) if c in log.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])

    return full(tech, "tech").unionByName(full(social, "social"))


def _deal(rows: DataFrame, total: int, most: int = WRITE_ROWS) -> DataFrame:
    """The rows month by month in tasks of about `most`, whatever a file or a month holds: a writer sorts those of its task."""
    if total <= most:
        return rows
    return rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(-(-total // most), "month", "_at").drop("_at")


def add_batch(batch: DataFrame, number: int, path: str) -> None:
    """Bring graphs and panel up to date with the rows of a batch; a batch without rows changes nothing."""
    spark = batch.sparkSession
    rows = batch.where("project IS NOT NULL AND ts IS NOT NULL").withColumns(
        {"month": cleaning.month_index("ts").cast("int"), "batch": F.lit(number)})
    touched = settle(rows.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("_rows")))
    sizes = {r["month"]: r["n"] for r in touched.groupBy("month").agg(F.sum("_rows").alias("n")).collect()}  # the calendar bounds them
    touched, months = touched.select(*SLICE), sorted(sizes)
    if not months:
        return
    _deal(rows, sum(sizes.values())).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "month", "batch").parquet(f"{path}/log")
    stored = spark.read.schema(LOG + ", month int, batch int").option("basePath", f"{path}/log").parquet(
        *[f"{path}/log/month={m}" for m in months])
    stored = stored.where(F.col("batch") <= number).join(touched, SLICE, "left_semi").drop("batch")
    tech, social = (stored.where(F.col("kind") == k) for k in ("tech", "social"))
    replied = cleaning.infer_replies(settle(social.drop("kind", "file", "is_coding")), guarded=False)
    new_tech, new_social = settle(edges.tech_edges(tech)), settle(edges.social_graph(replied))
    for name, graph, kind in (("tech", new_tech, TECH_EDGE), ("social", new_social, SOCIAL_EDGE)):
        columns = [c.split()[0] for c in kind.split(", ")]
        store.save(graph.select(*columns), f"{path}/{name}", SLICE, number=number, by="month")
    near = touched.select("project", F.explode(F.array(F.col("month") - 1, "month", F.col("month") + 1)).alias("month")).distinct()
    around = sorted({m + k for m in months for k in (-1, 0, 1)})
    slices = [settle(store.load_buckets(spark, f"{path}/{name}", kind, around).join(near, SLICE, "left_semi"))
              for name, kind in (("tech", TECH_EDGE), ("social", SOCIAL_EDGE))]
    found = settle(panel.stack_features(*slices))
    own = touched.join(tech.groupBy(*SLICE).agg(F.lit(True).alias("has_tech")), SLICE, "left").join(found, SLICE, "left")
    own = own.withColumns({"has_tech": F.coalesce("has_tech", F.lit(False)), **{
        c: F.coalesce(c, F.lit(0).cast("long" if c in COUNT_FEATURES else "double")) for c in FEATURES}})
    # The months after touched ones: their graphs are as they were, their overlaps are not.
    after = touched.select("project", (F.col("month") + 1).alias("month")).join(touched, SLICE, "left_anti")
    flags = store.load_buckets(spark, f"{path}/panel", PANEL, sorted({m + 1 for m in months})).select(*SLICE, "has_tech")
    later = after.join(flags, SLICE).join(found, SLICE)
    columns = [c.split()[0] for c in PANEL.split(", ")]
    fresh = settle(own.select(*columns).unionByName(later.select(*columns)))
    store.save(fresh, f"{path}/panel", SLICE, number=number, by="month")
    for table in (touched, new_tech, new_social, *slices, found, fresh):
        drop_table(table)


def ingest_logs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Feed a stream of `as_rows` rows; ends when the input is used up."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_edges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The tech or the social graph of every (project, calendar month)."""
    return store.load(spark, f"{path}/{kind}", TECH_EDGE if kind == "tech" else SOCIAL_EDGE)


def current_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel as a batch run over all rows gives it: months from the first technical one, none left out."""
    rows = store.load(spark, f"{path}/panel", PANEL)
    first = F.min(F.when(F.col("has_tech"), F.col("month")))
    span = rows.groupBy("project").agg(F.coalesce(first, F.min("month")).alias("_start"), F.max("month").alias("_last"))
    lengths = span.select("project", (F.col("_last") - F.col("_start") + 1).cast("int").alias("months"))
    shifted = rows.join(span, "project").withColumn("month", (F.col("month") - F.col("_start")).cast("int")).where("month >= 0")
    zero = lambda c: F.when(F.col("month") == 0, F.lit(0.0)).otherwise(F.col(c))
    shifted = shifted.withColumns({c: zero(c) for c in ("t_net_overlap", "s_net_overlap")})
    return panel.in_order(panel.densify(shifted.select(*SLICE, *FEATURES), lengths, FEATURES))
