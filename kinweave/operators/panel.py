"""The monthly panel: one row per project and month, in fixed column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import cleaning, edges, features
from kinweave.schemas import COUNT_FEATURES, FEATURES, PANEL_COLUMNS, Logs
from kinweave.session import settle

SLICE = ["project", "month"]


def calendar(lengths: DataFrame) -> DataFrame:
    """Every month of every project; projects of length 0 have none."""
    return lengths.where("months > 0").select(
        "project", F.explode(F.sequence(F.lit(0), F.col("months") - 1)).alias("month"))


def densify(rows: DataFrame, lengths: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows for all months of the calendar, 0 where a feature is missing.

    The calendar joins the features by union and one grouping, so any number of
    feature tables meet in a single shuffle of rows per (project, month).
    """
    columns = columns or [c for c in rows.columns if c not in SLICE]
    days = calendar(lengths).withColumn("_in", F.lit(1))
    stacked = days.unionByName(rows, allowMissingColumns=True)
    full = stacked.groupBy(*SLICE).agg(
        F.max("_in").alias("_in"),
        *[F.coalesce(F.max(c), F.lit(0).cast("long" if c in COUNT_FEATURES else "double")).alias(c)
          for c in columns])
    return full.where("_in = 1").drop("_in")


def stack_features(tech: DataFrame, social: DataFrame) -> DataFrame:
    """All feature tables of the two (settled) graphs as one row per month."""
    both = tech.select(*SLICE, F.lit("t").alias("graph"), F.col("file").alias("a"), F.col("dev").alias("b")).unionByName(
        social.select(*SLICE, F.lit("s").alias("graph"), F.col("src").alias("a"), F.col("dst").alias("b")))
    shared = features.overlap(both, ["a", "b"], "x", ["graph"])
    of = lambda g, alias: F.when(F.col("graph") == g, F.col("x")).alias(alias)
    parts = [
        features.tech_features(tech),
        features.social_features(social),
        features.clustering_sums(social, total=social.count()),
        features.components(social),
        shared.select(*SLICE, of("t", "t_net_overlap"), of("s", "s_net_overlap")),
        features.shared_devs(tech, social),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    mean = F.coalesce(F.max("c"), F.lit(0.0)) / F.max("s_num_nodes")
    return rows.groupBy(*SLICE).agg(*[
        (mean if c == "s_avg_clustering_coef" else F.max(c)).alias(c) for c in FEATURES])


def in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("project", "proj_name").select(*PANEL_COLUMNS)


def build_panel(tech: DataFrame, social: DataFrame, lengths: DataFrame) -> DataFrame:
    """Panel from edge tables.  Both are read several times, so pass settled tables."""
    return in_order(densify(stack_features(tech, social), lengths, FEATURES))


def _authored(log: DataFrame) -> DataFrame:
    """Calendar month for every row; sender and 0 where author and bot flag are not set."""
    extra = {"month": cleaning.month_index("ts")}
    if "is_bot" not in log.columns:
        extra["is_bot"] = F.lit(0)
    if "dev" not in log.columns:
        extra["dev"] = F.col("sender")
    return log.withColumns(extra)


def _span(tech: DataFrame, social: DataFrame, known: DataFrame | None) -> DataFrame:
    """First and last calendar month of each project, one pass over each log."""
    month = cleaning.month_index("ts")
    ends = lambda df, name: df.groupBy("project").agg(
        F.min(month).alias(name), F.max(month).alias("_last"))
    both = ends(tech, "_t").unionByName(ends(social, "_s"), allowMissingColumns=True)
    span = both.groupBy("project").agg(
        F.coalesce(F.min("_t"), F.min("_s")).alias("_start"), F.max("_last").alias("_last"))
    if known is None:
        return span
    old = known.select("project", cleaning.month_index("start").alias("_known"))
    return span.join(old, "project", "left").select(
        "project", F.coalesce("_known", "_start").alias("_start"), "_last")


def panel_from_logs(logs: Logs, extensions: list[str] | None = None,
                    known_starts: DataFrame | None = None) -> DataFrame:
    """Panel straight from the raw logs.

    Graphs are keyed by calendar month, which every row knows by itself; the
    project start is subtracted from the finished monthly rows.  So no raw row
    is joined to its project and no project's rows meet in one task.
    """
    tech = _authored(cleaning.clean_source_files(cleaning.clean_file_paths(logs.tech), extensions))
    social = cleaning.infer_replies(_authored(logs.social))
    span = settle(_span(tech, logs.social, known_starts))
    t_edges = settle(edges.tech_edges(tech))
    s_edges = settle(edges.social_graph(social))
    rows = stack_features(t_edges, s_edges).join(span.select("project", "_start"), "project")
    month = (F.col("month") - F.col("_start")).cast("int")
    rows = rows.withColumn("month", month).where("month >= 0").drop("_start")
    first = lambda c: F.when(F.col("month") == 0, F.lit(0.0)).otherwise(F.col(c))
    rows = rows.withColumns({c: first(c) for c in ("t_net_overlap", "s_net_overlap")})
    lengths = span.select("project", (F.col("_last") - F.col("_start") + 1).cast("int").alias("months"))
    return in_order(densify(rows, lengths, FEATURES))
