"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import cleaning, contracts, edges, panel, scoring, trajectories, transforms
from kinweave.schemas import Logs
from kinweave.session import settle
from kinweave.streaming import delta


def canonical(logs: Logs) -> Logs:
    """Request field names to the short names the operators use."""
    tech = logs.tech.select(
        F.col("project_name").alias("project"), F.col("date").cast("timestamp_ntz").alias("ts"),
        F.col("sender_name").alias("sender"), F.col("file_name").alias("file"))
    social = logs.social.select(
        F.col("project_name").alias("project"), F.col("date").cast("timestamp_ntz").alias("ts"),
        F.col("sender_name").alias("sender"), "subject",
        F.col("comment_id").cast("string").alias("message_id"), "in_reply_to")
    return Logs(tech, social)


def prepare(tech: DataFrame, social: DataFrame, steps: list[str] | None = None) -> Logs:
    """Incoming logs to cleaned ones: contracts, months, message ids, replies, flags, authors."""
    logs = canonical(contracts.ensure(contracts.translate(tech, social)))
    logs = Logs(settle(logs.tech), settle(logs.social))  # read by starts, graphs and last months
    return cleaning.process(
        logs, steps or ["files", "months", "message_ids", "replies", "sources", "bots", "names"])


def compute(tech: DataFrame, social: DataFrame, tasks: list[str], months: tuple[int, int] = (0, -1),
            model: PipelineModel | None = None, steps: list[str] | None = None,
            stored: dict[str, DataFrame] | None = None, strategy: str = "AR", lag: int = 3, k: int = 3,
            ) -> dict[str, DataFrame]:
    """The asked products over a range of months.

    `net-gen` is the panel, `net-vis` the graphs as JSON pages, `forecast` the
    monthly scores of `model`, `traj` their continuation.  An end month of 0 or
    less means the last month both logs reach.  Edge tables are settled once and
    shared by all products.  `strategy`, `lag` and `k` are those of `trajectories`.

    `stored` holds products of earlier runs by the same names.  With a stored
    panel only the months after it are computed, from the rows since its last
    month; new pages replace stored ones, stored scores and paths are kept.
    """
    stored = stored or {}
    unknown = set(tasks) - {"net-gen", "net-vis", "forecast", "traj"}
    if unknown:
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    if {"forecast", "traj"} & set(tasks) and model is None:
        raise ValueError("forecasts need a trained model")
    logs = prepare(tech, social, steps)
    logs = Logs(*[
        df if "is_bot" in df.columns else df.withColumn("is_bot", F.lit(0)) for df in (logs.tech, logs.social)])
    known = settle(delta.cached_months(stored["net-gen"])) if "net-gen" in stored else None
    recent = logs if known is None else Logs(delta.since(logs.tech, known, 1), delta.since(logs.social, known, 1))
    t_edges, s_edges = settle(edges.tech_edges(recent.tech)), settle(edges.social_graph(recent.social))
    last_t, last_s = [
        settle(df.groupBy("project").agg(F.max("month").alias("month"))) for df in (logs.tech, logs.social)]
    lengths = cleaning.project_length(last_t, last_s)
    ends = contracts.infer_end(last_t, last_s, months[1])
    rows = panel.build_panel(t_edges, s_edges, lengths)
    rows = settle(rows if known is None else delta.extend_panel(rows, stored["net-gen"], known))

    def merged(name: str, product: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        return merge(product, stored[name].select(*product.columns)) if name in stored else product

    def cut(product: DataFrame, key: str = "project") -> DataFrame:
        limit = ends.select(F.col("project").alias(key), F.col("end_month").alias("_end"))
        kept = product.join(limit, key).where((F.col("month") >= months[0]) & (F.col("month") <= F.col("_end")))
        return kept.select(*product.columns)

    out: dict[str, DataFrame] = {}
    if "net-gen" in tasks:
        out["net-gen"] = cut(rows, "proj_name")
    if "net-vis" in tasks:
        pages = edges.vis_package(t_edges, s_edges)
        if known is not None:
            first = known.select(F.col("project").alias("_p"), "next")
            pages = pages.join(first, F.col("project") == F.col("_p"), "left").where(
                F.col("month") >= F.coalesce("next", F.lit(0))).select(*pages.columns)
        out["net-vis"] = cut(merged("net-vis", pages, delta.merge_vis))
    if "forecast" in tasks or "traj" in tasks:
        scores = settle(scoring.score_months(transforms.normalise(rows), model))
        if "forecast" in tasks:
            out["forecast"] = cut(merged("forecast", scores, scoring.merge_forecasts))
        if "traj" in tasks:
            lags = trajectories.effective_lag(scores).withColumnRenamed("project", "_p")
            paths = trajectories.trajectories(scores, strategy, lag, k)
            late = paths.join(lags, (F.col("project") == F.col("_p")) & (F.col("month") >= F.col("lag")))
            out["traj"] = cut(merged("traj", late.select(*paths.columns), trajectories.merge_trajectories))
    return out
