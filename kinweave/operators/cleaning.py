"""Log cleaning and imputation."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import identity
from kinweave.operators.ordering import previous
from kinweave.operators.skew import lookup
from kinweave.schemas import Logs
from kinweave.session import settle

log = logging.getLogger(__name__)

# Extensions that count as source files when no list is given.
CODING_EXTENSIONS = [
    ".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".java", ".js", ".kt",
    ".lua", ".m", ".mdtext", ".php", ".pl", ".py", ".r", ".rb", ".rs", ".scala", ".sh", ".sql",
    ".swift", ".ts", ".xhtml",
]

# Name parts that mark an automatic account.
BOT_SUBSTRINGS = [
    "bot", "butler", "crawler", "gardener", "github", "lint", "robot", "scraper", "spider",
    "no-reply", "noreply",
]
BOT_NAMES = ["github"]


def clean_file_paths(tech: DataFrame) -> DataFrame:
    return tech.withColumn("file", text.file_path(F.col("file")))


def count_changed_paths(tech: DataFrame) -> DataFrame:
    changed = ~F.col("file").eqNullSafe(text.file_path(F.col("file")))
    return tech.agg(F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("changed_paths"))


def clean_sender_names(social: DataFrame, source: str = "sender", into: str = "dev") -> DataFrame:
    return social.withColumn(into, text.sender_name(F.col(source)))


def month_index(ts) -> F.Column:
    """Months since year 0, a month number that needs no project start."""
    return F.year(ts) * 12 + F.month(ts) - 1


def project_starts(logs: Logs, known: DataFrame | None = None) -> DataFrame:
    """First technical row of each project, its first social row where it has none.

    `known` start dates, once seen, are never moved.
    """
    tech = logs.tech.groupBy("project").agg(
        F.min("ts").alias("_t"), F.count(F.lit(1)).alias("tech_rows"))
    social = logs.social.groupBy("project").agg(
        F.min("ts").alias("_s"), F.count(F.lit(1)).alias("social_rows"))
    starts = tech.join(social, "project", "full_outer").select(
        "project",
        F.coalesce("_t", "_s").alias("start"),
        F.coalesce("tech_rows", F.lit(0)).alias("tech_rows"),
        F.coalesce("social_rows", F.lit(0)).alias("social_rows"),
    )
    if known is None:
        return starts
    old = known.select("project", F.col("start").alias("_known"))
    return starts.join(old, "project", "left").withColumn(
        "start", F.coalesce("_known", "start")).drop("_known")


def upsert_start_dates(starts: DataFrame, known: DataFrame) -> DataFrame:
    """The stored start dates plus those of projects not seen before."""
    fresh = starts.select("project", "start").join(known, "project", "left_anti")
    return known.select("project", "start").unionByName(fresh)


def impute_months(logs: Logs, strategy: str = "month", known: DataFrame | None = None) -> Logs:
    """Number the rows by month since the project start, or by 30-day steps.

    Calendar months count from the project start and rows before it go; fixed
    steps count from each log's own first row.
    """
    if strategy == "month":
        starts = settle(project_starts(logs, known))

        def one(df: DataFrame, weight: str) -> DataFrame:
            table = starts.select("project", month_index("start").alias("_start"), weight)
            rows = lookup(df, table, ["project"], weight, settled=True)
            rows = rows.withColumn("month", (month_index("ts") - F.col("_start")).cast("int"))
            return rows.drop("_start").where("month >= 0")

        return Logs(one(logs.tech, "tech_rows"), one(logs.social, "social_rows"))
    if strategy == "day":
        def steps(df: DataFrame) -> DataFrame:
            first = df.groupBy("project").agg(
                F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_n"))
            days = F.timestamp_diff("DAY", F.col("_first"), F.col("ts"))
            return (
                lookup(df, first, ["project"], "_n")
                .withColumn("month", F.floor(days / 30).cast("int"))
                .drop("_first")
            )

        return Logs(steps(logs.tech), steps(logs.social))
    raise ValueError(f"unknown month strategy {strategy!r}")


def impute_message_id(social: DataFrame) -> DataFrame:
    raw = F.concat(
        F.lit("<"), text.utc_text("ts"), F.lit("="), F.col("project"), F.lit("@"), F.col("sender"),
        F.lit(">"),
    )
    return social.withColumn("message_id", F.replace(raw, F.lit(" "), F.lit("")))


def reply_guard(social: DataFrame) -> DataFrame:
    """One row: share of threads with more than one message, share of distinct replies."""
    sizes = social.groupBy("project", "month", "subject").agg(F.count(F.lit(1)).alias("n"))
    share = F.avg((F.col("n") > 1).cast("double")).alias("threaded")
    verdict = (
        (F.col("threaded") > F.col("filled")) & (F.col("filled") <= 0.95)).cast("int").alias("infer")
    if "in_reply_to" not in social.columns:  # one value, the missing one
        one = sizes.agg(share, (1 / F.greatest(F.sum("n"), F.lit(1))).alias("filled"))
        return one.select("threaded", "filled", verdict)
    threads = sizes.agg(share)
    filled = social.agg(
        (F.count_distinct(F.coalesce("in_reply_to", F.lit("\0")))
         / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("filled"))
    return threads.withColumn("k", F.lit(1)).join(filled.withColumn("k", F.lit(1)), "k").select(
        "threaded", "filled", verdict)


def infer_replies(social: DataFrame, guarded: bool = True) -> DataFrame:
    """Let each message answer the one before it in its thread.

    The guard keeps given replies when they say more than the threads do.  A
    thread may hold most of the log, so the lag runs over ordered slices
    instead of one window per thread.  The log is read three times (guard, slice
    borders, slices), so pass a settled one where it took work to make.
    """
    if guarded:
        verdict = reply_guard(social).first()
        if verdict is None or not verdict["infer"]:
            log.warning("reply fields kept: the threads would not say more")
            return social if "in_reply_to" in social.columns else social.withColumn("in_reply_to", F.lit(""))
    rows = previous(social, ["project", "subject"], ["ts", "message_id"], "message_id", "_before")
    known = F.col("subject").isNotNull() & F.col("project").isNotNull()
    reply = F.when(known & (F.col("_before") == F.col("message_id")), "").otherwise(
        F.when(known, F.col("_before")))
    return rows.withColumn("in_reply_to", reply).drop("_before")


def clean_source_files(tech: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    known = sorted({e.lower() for e in (extensions or CODING_EXTENSIONS)} | {".mdtext"})
    flag = F.coalesce(text.extension(F.col("file")).isin(known), F.lit(False))
    return tech.withColumn("is_coding", flag.cast("int"))


def bots_report(df: DataFrame, substrings: list[str], names: list[str],
                threshold: float = 0.05) -> DataFrame:
    """Per project and sender: name tests, share of the project's rows, verdict.

    The log is counted once per sender; the project totals add up those counts.
    """
    sent = df.groupBy("project", "sender").agg(F.count(F.lit(1)).alias("n"))
    counts = sent.where("sender IS NOT NULL")
    every = sent.groupBy("project").agg(F.sum("n").alias("total"))
    low = F.lower("sender")
    part = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in substrings], F.lit(False))
    exact = low.isin([n.lower() for n in names]) if names else F.lit(False)
    share = F.col("n") / F.greatest("total", F.lit(1))
    return counts.join(every, "project").select(
        "project", "sender", "n",
        part.cast("int").alias("substring"),
        (share > threshold).cast("int").alias("outlier"),
        share.alias("share"),
        (exact | (part & (share > threshold))).cast("int").alias("is_bot"),
    )


def infer_bots(logs: Logs, substrings: list[str] | None = None, names: list[str] | None = None,
               threshold: float = 0.05) -> Logs:
    """Flag the rows of automatic accounts; a name flagged in one project counts in all."""
    substrings = BOT_SUBSTRINGS if substrings is None else substrings
    names = BOT_NAMES if names is None else names

    def one(df: DataFrame) -> DataFrame:
        table = bots_report(df, substrings, names, threshold).groupBy("sender").agg(
            F.max("is_bot").alias("_bot"), F.sum("n").alias("_n"))
        return lookup(df, table, ["sender"], "_n").withColumn(
            "is_bot", F.coalesce("_bot", F.lit(0))).drop("_bot")

    return Logs(one(logs.tech), one(logs.social))


def project_length(tech: DataFrame, social: DataFrame) -> DataFrame:
    both = tech.select("project", "month").unionByName(social.select("project", "month"))
    return both.groupBy("project").agg((F.max("month") + 1).cast("int").alias("months"))


def relative_time(df: DataFrame, strategy: str = "default", base: str = "apache",
                  ratios: dict[str, float] | None = None) -> DataFrame:
    """Scale months by the lifecycle ratio of the row's incubator (`static`), else leave them."""
    if strategy in ("default", "dynamic"):
        return df
    if strategy != "static":
        raise ValueError(f"unknown time strategy {strategy!r}")
    ratio = F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv])
    factor = F.lit(float(ratios[base])) / ratio[F.col("incubator")]
    return df.withColumn("month", F.floor(factor * F.col("month")).cast("int"))


def segment_months(df: DataFrame, author: str = "dev") -> DataFrame:
    """Rows that belong to a (project, month) slice; empty slices never appear."""
    return df.where(F.col(author).isNotNull())


def passthrough_author(logs: Logs, field: str = "sender") -> Logs:
    return Logs(logs.tech.withColumn("dev", F.col(field)), logs.social.withColumn("dev", F.col(field)))


STEPS: dict[str, Callable[[Logs], Logs]] = {
    "files": lambda logs: logs.with_tech(clean_file_paths(logs.tech)),
    "senders": lambda logs: logs.with_social(clean_sender_names(logs.social)),
    "months": impute_months,
    "message_ids": lambda logs: logs.with_social(impute_message_id(logs.social)),
    "replies": lambda logs: logs.with_social(infer_replies(settle(logs.social))),
    "sources": lambda logs: logs.with_tech(clean_source_files(logs.tech)),
    "bots": infer_bots,
    "names": passthrough_author,
    "aliases": lambda logs: identity.dealias(Logs(settle(logs.tech), settle(logs.social))),
}


def process(logs: Logs, steps: list[str], extra: dict[str, Callable[[Logs], Logs]] | None = None) -> Logs:
    """Run the named cleaning steps in the order given; unknown names are reported and skipped."""
    table = {**STEPS, **(extra or {})}
    for name in steps:
        if name not in table:
            log.warning("unknown cleaning step %s", name)
            continue
        logs = table[name](logs)
    return logs
