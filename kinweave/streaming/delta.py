"""Adding new months to a stored panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import edges, panel
from kinweave.operators.scoring import merge_keyed
from kinweave.operators.skew import lookup
from kinweave.schemas import PANEL_COLUMNS, Logs
from kinweave.session import settle


def cached_months(cached: DataFrame, last_month: int | None = None) -> DataFrame:
    """Per project the first month that is not stored: the number of stored rows, or as given."""
    rows = cached.groupBy(F.col("proj_name").alias("project")).agg(F.count(F.lit(1)).cast("int").alias("next"))
    return rows if last_month is None else rows.withColumn("next", F.least("next", F.lit(last_month)))


def since(log: DataFrame, months: DataFrame, back: int) -> DataFrame:
    counts = log.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    table = counts.join(months, "project", "left").select(
        "project", "_n", F.coalesce("next", F.lit(0)).alias("_next"))
    return lookup(log, table, ["project"], "_n").where(F.col("month") >= F.col("_next") - back).drop("_next")


def drop_late(logs: Logs, months: DataFrame) -> Logs:
    """Rows of months that are already stored are late and go."""
    return Logs(since(logs.tech, months, 0), since(logs.social, months, 0))


def delta_panel(logs: Logs, cached: DataFrame, last_month: int | None = None) -> DataFrame:
    """The stored months plus those computed from the logs after them.

    Logs carry month, author, flags and replies.  One stored month is read back
    for the overlap of the first new one, so the result equals a full run.
    """
    months = settle(cached_months(cached, last_month))
    logs = Logs(since(logs.tech, months, 1), since(logs.social, months, 1))
    tech, social = settle(edges.tech_edges(logs.tech)), settle(edges.social_graph(logs.social))
    seen = logs.tech.select("project", "month").unionByName(logs.social.select("project", "month"))
    lengths = seen.groupBy("project").agg((F.max("month") + 1).cast("int").alias("months"))
    return extend_panel(panel.build_panel(tech, social, lengths), cached, months)


def extend_panel(rows: DataFrame, cached: DataFrame, months: DataFrame) -> DataFrame:
    """Stored months before `months.next`, computed `rows` from there on."""
    start = F.col("proj_name") == F.col("project")
    fresh = rows.join(months, start, "left").where(
        F.col("month") >= F.coalesce("next", F.lit(0))).select(*PANEL_COLUMNS)
    old = cached.join(months, start).where(F.col("month") < F.col("next")).select(*PANEL_COLUMNS)
    return old.unionByName(fresh)


def merge_vis(new: DataFrame, cached: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """New months replace the stored ones."""
    return merge_keyed(new, cached, keys or ["project", "graph", "month", "page"])


def new_length(tech: DataFrame, social: DataFrame, months: DataFrame) -> DataFrame:
    """Months still to be computed: last month less the stored ones, plus one."""
    both = tech.select("project", "month").unionByName(social.select("project", "month"))
    last = both.groupBy("project").agg(F.max("month").alias("_m"))
    return last.join(months, "project", "left").select(
        "project", (F.col("_m") - F.coalesce("next", F.lit(0)) + 1).cast("int").alias("months"))
