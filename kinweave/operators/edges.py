"""Monthly graphs as plain edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators.ordering import row_numbers

SLICE = ["project", "month"]


def tech_edges(tech: DataFrame) -> DataFrame:
    """Touches of each file by each developer, by month; people and source files only."""
    kept = tech.where("is_bot = 0 AND is_coding = 1 AND dev IS NOT NULL")
    return (
        kept.select(*SLICE, text.base_name(F.col("file")).alias("file"), "dev")
        .groupBy(*SLICE, "file", "dev")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _people(social: DataFrame) -> DataFrame:
    return social.where("is_bot = 0 AND dev IS NOT NULL")


def message_index(social: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Author and time of each message id of a month; the latest row of an id counts."""
    keys = SLICE if keys is None else keys
    return (
        _people(social)
        .groupBy(*keys, F.trim("message_id").alias("reference"))
        .agg(F.max_by(F.struct("dev", "ts"), F.struct("ts", "dev")).alias("_m"))
        .select(*keys, "reference", F.col("_m.dev").alias("prev_dev"), F.col("_m.ts").alias("prev_ts"))
    )


def reply_pairs(social: DataFrame, cross_month: bool = False) -> DataFrame:
    """One row per message and earlier author it answers.

    Equal rows of the log are folded into a count `n` first, so copies of one
    message cost one row.  By default only messages of the same month are found.
    """
    keys = ["project"] if cross_month else SLICE
    return _pairs(social, message_index(social, keys), keys)


def _pairs(social: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    message = [*SLICE, "message_id", "dev", "ts", "in_reply_to"]
    asked = (
        _people(social)
        .where(F.col("in_reply_to").contains("<") & F.col("in_reply_to").contains(">"))
        .groupBy(*message).agg(F.count(F.lit(1)).alias("n"))
        .select(*message, "n", F.posexplode(text.reference_tokens(F.col("in_reply_to"))).alias("pos", "reference"))
    )
    found = asked.join(index, [*keys, "reference"]).where("prev_dev <> dev")
    first = found.groupBy(*message, "prev_dev").agg(
        F.min_by(F.struct("reference", "prev_ts"), "pos").alias("_r"), F.first("n").alias("n"))
    return first.select(
        *SLICE, F.trim("message_id").alias("message_id"), "dev", "ts",
        F.col("_r.reference").alias("reference"), "prev_dev", F.col("_r.prev_ts").alias("prev_ts"), "n")


def social_edges(pairs: DataFrame) -> DataFrame:
    """Signals both ways along each reply, summed."""
    ends = F.array(
        F.struct(F.col("dev").alias("src"), F.col("prev_dev").alias("dst")),
        F.struct(F.col("prev_dev").alias("src"), F.col("dev").alias("dst")))
    return (
        pairs.groupBy(*SLICE, "dev", "prev_dev").agg(F.sum("n").alias("n"))
        .select(*SLICE, F.explode(ends).alias("e"), "n")
        .groupBy(*SLICE, F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
        .agg(F.sum("n").alias("weight"))
    )


def presence_loops(social: DataFrame) -> DataFrame:
    """A weight-0 loop for every sender of a month, so that silent senders are nodes."""
    who = _people(social).select(*SLICE, "dev").distinct()
    return who.select(
        *SLICE, F.col("dev").alias("src"), F.col("dev").alias("dst"), F.lit(0).cast("long").alias("weight"))


def social_graph(social: DataFrame, cross_month: bool = False) -> DataFrame:
    """Reply edges and presence loops in one table.

    A message with one reference has one earlier author at most, so its pairs
    need no grouping by message; only messages with several take that way.
    """
    keys = ["project"] if cross_month else SLICE
    index = message_index(social, keys)
    field = F.col("in_reply_to")
    spaced = F.contains(field, F.lit(" ")) | F.contains(field, F.lit("\n")) | F.contains(field, F.lit("\t"))
    named = F.contains(field, F.lit("<")) & F.contains(field, F.lit(">"))
    single = _people(social).where(named & ~spaced).select(*SLICE, "dev", field.alias("reference"))
    single = single.join(index.drop("prev_ts"), [*keys, "reference"]).where("prev_dev <> dev").select(
        *SLICE, "dev", "prev_dev", F.lit(1).cast("long").alias("n"))
    several = _pairs(social.where(spaced), index, keys).select(*SLICE, "dev", "prev_dev", "n")
    ends = F.explode(F.array(
        F.struct(F.col("dev").alias("src"), F.col("prev_dev").alias("dst")),
        F.struct(F.col("prev_dev").alias("src"), F.col("dev").alias("dst"))))
    replies = single.unionByName(several).select(*SLICE, ends.alias("e"), "n").select(
        *SLICE, "e.src", "e.dst", "n")
    loops = _people(social).select(
        *SLICE, F.col("dev").alias("src"), F.col("dev").alias("dst"), F.lit(0).cast("long").alias("n"))
    return replies.unionByName(loops).groupBy(*SLICE, "src", "dst").agg(F.sum("n").alias("weight"))


def interaction_map(pairs: DataFrame) -> DataFrame:
    """Two rows per reply: what the sender sent, and what the earlier author had sent out."""
    sent = F.struct(
        F.col("message_id").alias("message_id"), F.col("dev").alias("sender"),
        F.col("prev_dev").alias("receiver"), F.col("ts").alias("ts"), F.lit(0).alias("broadcast"))
    heard = F.struct(
        F.col("reference").alias("message_id"), F.col("prev_dev").alias("sender"),
        F.col("dev").alias("receiver"), F.col("prev_ts").alias("ts"), F.lit(1).alias("broadcast"))
    copies = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    return pairs.withColumn("_copy", copies).select("project", F.explode(F.array(sent, heard)).alias("e")).select(
        "project", "e.message_id", "e.sender", "e.receiver", "e.ts", "e.broadcast")


def vis_tech(edges: DataFrame) -> DataFrame:
    """Touches per developer and file type, by month."""
    kind = F.element_at(F.split("file", r"\."), -1)
    return edges.groupBy(*SLICE, F.col("dev"), kind.alias("kind")).agg(F.sum("weight").alias("weight"))


def vis_social(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*SLICE, "src", "dst").agg(F.sum("weight").alias("weight"))


def vis_package(tech: DataFrame, social: DataFrame, project: str | None = None,
                page_rows: int = 10_000) -> DataFrame:
    """JSON lists of (from, to, weight) per project, graph kind and month.

    A month with many rows is cut into pages of `page_rows`, so no month has to
    fit one task.  With `project` given, rows of any other project are an error.
    """
    rows = (
        vis_tech(tech).select(*SLICE, F.lit("tech").alias("graph"), F.col("dev").alias("a"), F.col("kind").alias("b"), "weight")
        .unionByName(vis_social(social).select(
            *SLICE, F.lit("social").alias("graph"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))
    )
    if project is not None:
        other = rows.where(F.col("project") != project).select("project").limit(1).collect()
        if other:
            raise ValueError(f"rows of another project: {other[0]['project']}")
    group = ["project", "graph", "month"]
    numbered = row_numbers(rows, group, ["a", "b"], "_rank")
    page = F.floor((F.col("_rank") - 1) / page_rows).cast("int")
    cells = F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "a", "b", "weight"))),
        lambda r: F.struct(r.a.alias("from"), r.b.alias("to"), r.weight.alias("weight")))
    return numbered.groupBy(*group, page.alias("page")).agg(
        F.count(F.lit(1)).alias("rows"), F.to_json(cells).alias("edges"))
