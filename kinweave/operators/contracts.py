"""Schema contracts, projections and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import text
from kinweave.operators.ordering import row_numbers
from kinweave.operators.skew import lookup
from kinweave.schemas import OPTIONAL, REQUIRED, SOCIAL_FIELDS, TECH_FIELDS, Logs


def _rename(df: DataFrame, fields: dict[str, str], kind: str) -> DataFrame:
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns in the {kind} log: {missing}")
    return df.select(*[F.col(src).alias(dst) for src, dst in fields.items()])


def empty_log(spark, fields: dict[str, str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
    return spark.createDataFrame([], schema)


def translate(tech: DataFrame | None, social: DataFrame | None) -> Logs:
    """Keep and rename the known fields; one log may be absent or without rows, not both."""
    given = [df for df in (tech, social) if df is not None]
    filled = [df for df in given if not df.isEmpty()]
    if not filled:
        raise ValueError("both logs are empty; at least one must hold rows")
    spark = filled[0].sparkSession
    if tech is None or not any(df is tech for df in filled):
        tech = empty_log(spark, TECH_FIELDS)
    if social is None or not any(df is social for df in filled):
        social = empty_log(spark, SOCIAL_FIELDS)
    return Logs(_rename(tech, TECH_FIELDS, "technical"), _rename(social, SOCIAL_FIELDS, "social"))


def ensure(logs: Logs) -> Logs:
    """Fail on a missing required column, fill a missing optional one with its blank."""

    def one(df: DataFrame, kind: str) -> DataFrame:
        missing = [c for c in REQUIRED[kind] if c not in df.columns]
        if missing:
            raise ValueError(f"missing required columns in the {kind} log: {missing}")
        blanks = {c: F.lit(v) for c, v in OPTIONAL[kind].items() if c not in df.columns}
        return df.withColumns(blanks) if blanks else df

    return Logs(one(logs.tech, "tech"), one(logs.social, "social"))


def enforce(df: DataFrame, kind: str, source: str = "sender_name",
            order: list[str] | None = None) -> DataFrame:
    """Drop free-text and ignored columns, add the derived ones with their defaults.

    A missing message id becomes the row's number under `order`.
    """
    drop = [c for c in df.columns if "[IGNORE]" in c]
    drop += [c for c in ("body", "commit_msg", "reactions", "reactions\r") if c in df.columns]
    df = df.drop(*drop)
    fill: dict[str, Column] = {}
    if "author" not in df.columns:
        fill["author"] = F.col(source)
    if "is_bot" not in df.columns:
        fill["is_bot"] = F.lit(0)
    if kind == "tech" and "is_coding" not in df.columns:
        fill["is_coding"] = F.lit(1)
    if kind == "social" and "in_reply_to" not in df.columns:
        fill["in_reply_to"] = F.lit("")
    df = df.withColumns(fill) if fill else df
    if kind == "social" and "message_id" not in df.columns:
        df = row_numbers(df, [], order or df.columns, "_n")
        df = df.withColumn("message_id", F.col("_n") - 1).drop("_n")
    return df


def rebase_months(df: DataFrame) -> DataFrame:
    """Let every project start at month 0 where its first month is later."""
    first = df.groupBy("project").agg(F.min("month").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shifted = F.col("month") - F.greatest(F.col("_first"), F.lit(0))
    return lookup(df, first, ["project"], "_n").withColumn("month", shifted).drop("_first")


def require_tech(social: DataFrame, tech: DataFrame) -> DataFrame:
    """Keep the social rows of projects that have technical rows."""
    return social.join(tech.select("project").distinct(), "project", "left_semi")


def missing_profile(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.05) -> DataFrame:
    """Blank or null entries per column, flagged above `threshold`; one pass over the rows."""
    cols = cols or df.columns
    counts = [
        F.coalesce(
            F.sum((F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("long")), F.lit(0)
        ).alias(c)
        for c in cols
    ]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *counts)
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    share = F.col("missing") / F.greatest(F.col("total"), F.lit(1))
    return (
        one.selectExpr("_n AS total", f"stack({len(cols)}, {pairs}) AS (column_name, missing)")
        .withColumn("over_threshold", (share > threshold).cast("int"))
    )


def clean_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: text.free_text(F.col(c)) for c in cols})


def count_cleaned(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of distinct cleaned rows that differ from their original."""
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(text.free_text(F.col(c)))
    return clean_strings(df.where(changed), cols).distinct().agg(
        F.count(F.lit(1)).alias("changed_rows")
    )


def clean_lines(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.raw_lines(F.col(col)))


def clean_project_name(df: DataFrame, col: str = "project") -> DataFrame:
    return df.withColumn(col, text.project_name(F.col(col)))


def flatten_groups(groups: DataFrame) -> DataFrame:
    """(technology, parent, children) to one row per project with its parent.

    Parents without children are left out; a parent is its own parent.
    """
    kept = groups.where(F.size("children") > 0).select(
        text.project_name(F.col("parent")).alias("parent"), "children"
    )
    own = kept.select(F.col("parent").alias("project"), "parent")
    child = kept.select(F.explode("children").alias("project"), "parent")
    return own.unionByName(child).groupBy("project").agg(F.max("parent").alias("parent"))


def rollup(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Replace every project by its parent; unknown projects stay.

    The group table is small by nature, so Catalyst's own size test decides on
    a broadcast; past it the skew-join rule splits hot projects.
    """
    parents = groups.select("project", F.col("parent").alias("_parent"))
    return (
        df.join(parents, "project", "left")
        .withColumn("project", F.coalesce("_parent", "project"))
        .select(*df.columns)
    )


# The order in which a status is tested.
STATUS_ORDER = {"graduated": 3, "retired": 2, "incubating": 1}


def rollup_status(status: DataFrame, groups: DataFrame) -> DataFrame:
    """Give each parent the leading status among its own and its children's."""
    rank = F.create_map(*[F.lit(x) for kv in STATUS_ORDER.items() for x in kv])
    return (
        rollup(status, groups)
        .groupBy("project")
        .agg(F.max_by("status", rank[F.col("status")]).alias("status"))
    )


def clean_threads(social: DataFrame) -> DataFrame:
    """User names for mail addresses; the mail title without `Re:` names the thread."""
    sender = F.replace(F.split_part("sender_name", F.lit("@"), F.lit(1)), F.lit("#"), F.lit(""))
    mail = F.col("type") == "email"
    title = F.replace("title", F.lit("Re:"), F.lit(""))
    return social.withColumns({
        "sender_name": sender,
        "author": sender,
        "title": F.when(mail, title).otherwise(F.col("title")),
        "subject": F.when(mail, F.regexp_replace(title, r"\s+", "")).otherwise(F.col("subject")),
    })


def feature_subset(panel: DataFrame, include: list[str] | None = None,
                   exclude: list[str] | None = None) -> DataFrame:
    if include is not None:
        return panel.select(*include)
    return panel.drop(*(exclude if exclude is not None else ["s_largest_component"]))


def month_slice(product: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    kept = product.where(F.col("month") >= start)
    return kept if end is None else kept.where(F.col("month") <= end)


def infer_end(tech: DataFrame, social: DataFrame, end: int = -1) -> DataFrame:
    """The asked end month, or per project the lesser of the two logs' last months."""
    last = (
        tech.groupBy("project").agg(F.max("month").alias("_t"))
        .join(social.groupBy("project").agg(F.max("month").alias("_s")), "project", "full_outer")
    )
    limit = F.lit(end) if end > 0 else F.least("_t", "_s")
    return last.select("project", limit.cast("int").alias("end_month"))


def cache_coverage(products: DataFrame, ends: DataFrame) -> DataFrame:
    """Whether every stored product of a project reaches its end month.

    `products` has one row per (project, product, month).  A visual product is
    judged by its last month, every other by its number of months.
    """
    seen = products.groupBy("project", "product").agg(
        F.max("month").alias("last_month"), F.count_distinct("month").alias("months")
    )
    enough = F.when(F.col("product") == "vis", F.col("last_month") >= F.col("end_month")).otherwise(
        F.col("months") >= F.col("end_month") + 1
    )
    return seen.join(ends, "project").select(
        "project", "product", F.col("last_month").cast("int").alias("last_month"), "months",
        enough.cast("int").alias("covered"),
    )
