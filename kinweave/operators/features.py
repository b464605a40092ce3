"""Network features of every (project, month) graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import bitmaps
from kinweave.operators.components import SMALL_GRAPH, connected_components
from kinweave.operators.ordering import row_numbers
from kinweave.operators.skew import HOT_ROWS, lookup
from kinweave.session import settle, ship_functions

ship_functions(__name__)

SLICE = ["project", "month"]

# Fixed value: a note at the end of some file names that is not part of the name.
PROPERTY_NOTE = "   (with props)"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def tech_features(edges: DataFrame) -> DataFrame:
    """Developers, files, mean degrees and density of the developer-file graph.

    The distinct counts run on (month, name) keys before they meet in the
    month, so a month with most of the edges is still counted by many tasks.
    """
    pair = edges.select(*SLICE, "dev", F.replace("file", F.lit(PROPERTY_NOTE), F.lit("")).alias("file"))
    ends = F.explode(F.array(
        F.struct(F.lit("d").alias("kind"), F.col("dev").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("f").alias("kind"), F.col("file").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("e").alias("kind"), F.col("dev").alias("a"), F.col("file").alias("b"))))
    distinct = pair.select(*SLICE, ends.alias("x")).select(*SLICE, "x.kind", "x.a", "x.b").distinct()
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    counts = distinct.groupBy(*SLICE).agg(n("d").alias("d"), n("f").alias("f"), n("e").alias("e"))
    d, f, e = F.col("d"), F.col("f"), F.col("e")
    return counts.select(
        *SLICE, d.alias("t_num_dev_nodes"), f.alias("t_num_file_nodes"),
        _ratio(e, f).alias("t_num_dev_per_file"), _ratio(e, d).alias("t_num_file_per_dev"),
        _ratio(e, d * f).alias("t_graph_density"))


def social_features(edges: DataFrame) -> DataFrame:
    """Nodes, weighted mean degree and density (loops count as edges) of the social graph."""
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("weight").alias("w"), F.lit(1).cast("long").alias("e")),
        F.struct(F.col("dst").alias("node"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("e"))))
    nodes = edges.select(*SLICE, ends.alias("x")).groupBy(*SLICE, F.col("x.node").alias("node")).agg(
        F.sum("x.w").alias("w"), F.sum("x.e").alias("e"))
    total = nodes.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("e").alias("e"))
    n = F.col("n")
    return total.select(
        *SLICE, n.alias("s_num_nodes"), _ratio(2 * F.col("w"), n).alias("s_weighted_mean_degree"),
        F.when(n > 1, F.col("e") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("s_graph_density"))


def _corner_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(project, month, code, t) of a batch of edges (project, month, lo, hi, near, far): triangles per corner, summed up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        project, month = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        code = pc.fill_null(project.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        slices, of = np.unique(np.stack([code, month]), axis=1, return_inverse=True)
        of = of.reshape(-1)
        row, w, m = bitmaps.common(batch.column(4), batch.column(5))
        count = np.bincount(row, np.bitwise_count(m), batch.num_rows).astype(np.int64)
        group, top, times = bitmaps.members(of[row], w, m)
        ends = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)]
        key = np.stack([np.concatenate([of, of, group]), np.concatenate([*ends, top])])
        total = np.concatenate([count, count, times])
        some = total > 0
        if not some.any():
            continue
        corner, where = np.unique(key[:, some], axis=1, return_inverse=True)
        t = np.bincount(where.reshape(-1), total[some]).astype(np.int64)
        names = project.dictionary.take(pa.array(slices[0][corner[0]], mask=slices[0][corner[0]] < 0))
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(slices[1][corner[0]].astype(np.int32)), pa.array(corner[1]), pa.array(t)],
            names=["project", "month", "code", "t"])


def node_triangles(edges: DataFrame, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Degree and triangles of every node that has a neighbour.

    Nodes are numbered by (degree, name) in their month and edges point from the
    lower to the higher number, which keeps each out-list below the square root of
    twice the edges, hub or not.  Out-lists are sparse bitmaps; those at the two
    ends of an edge are intersected and counted in tasks, which pass on one sum per
    node and batch: neither open pairs nor triangles are ever rows.  `edges` holds
    each edge once in either direction, as the social graph does.
    """
    both = edges.where("src <> dst").select(*SLICE, F.col("src").alias("u"), F.col("dst").alias("v"))
    degree = both.groupBy(*SLICE, "u").agg(F.count(F.lit(1)).alias("_n"))
    coded = row_numbers(degree.withColumn("k", F.col("_n")), SLICE, ["k", "u"], "code")
    coded = settle(coded.withColumn("code", F.col("code").cast("long")))
    known = lookup(both, coded.select(*SLICE, "u", "_n", "code"), [*SLICE, "u"], "_n", hot_rows, total=total)
    first = F.col("u") < F.col("v")
    ends = known.groupBy(*SLICE, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        F.max(F.when(first, F.col("code"))).alias("ca"), F.max(F.when(~first, F.col("code"))).alias("cb"))
    aimed = settle(ends.select(*SLICE, F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")))
    word = F.shiftright("hi", 6).cast("int").alias("w")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hi").bitwiseAND(F.lit(63)).cast("int"))).alias("m")
    lists = aimed.groupBy(*SLICE, "lo", word).agg(mask, F.count(F.lit(1)).alias("_out")).groupBy(*SLICE, "lo").agg(
        F.sort_array(F.collect_list(F.struct("w", "m"))).alias("bits"), F.sum("_out").alias("_out"))
    lists = settle(lists)
    # A triangle's lowest corner has two edges out, its middle one an edge out.
    near = lists.where("_out > 1").select(*SLICE, "lo", F.col("bits").alias("near"))
    far = lists.select(*SLICE, F.col("lo").alias("hi"), F.col("bits").alias("far"))
    met = aimed.join(near, [*SLICE, "lo"]).join(far, [*SLICE, "hi"]).select(*SLICE, "lo", "hi", "near", "far")
    kinds = dict(edges.dtypes)
    counts = met.mapInArrow(_corner_counts, f"project {kinds['project']}, month int, code long, t long").groupBy(
        *SLICE, "code").agg(F.sum("t").alias("t"))
    return coded.join(counts, [*SLICE, "code"], "left").select(
        *SLICE, F.col("u").alias("node"), F.col("k").alias("degree"), F.coalesce("t", F.lit(0)).alias("triangles"))


def clustering_sums(edges: DataFrame, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Sum of the local clustering over the nodes of each month.

    Every edge runs both ways, so the undirected form holds.  `total` is the
    number of edge rows where it is known.
    """
    k = F.col("degree")
    local = F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(F.lit(0.0))
    return node_triangles(edges, hot_rows, total).groupBy(*SLICE).agg(F.sum(local).alias("c"))


def clustering(edges: DataFrame, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Mean local clustering."""
    sums = clustering_sums(edges, hot_rows, total)
    return social_features(edges).join(sums, SLICE, "left").select(
        *SLICE, (F.coalesce("c", F.lit(0.0)) / F.col("s_num_nodes")).alias("s_avg_clustering_coef"))


def components(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """Number of undirected components and size of the largest."""
    labels = connected_components(edges, SLICE, small)
    sizes = labels.groupBy(*SLICE, "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("s_num_component"), F.max("n").alias("s_largest_component"))


def overlap(edges: DataFrame, ends: list[str], alias: str, graph: list[str] | None = None) -> DataFrame:
    """Edges shared with the month before over the edges of both months.

    `edges` has one row per edge and month.  One window per edge (its months,
    few) finds the shared ones; the second window runs over months of a project.
    `graph` names columns that tell several graphs of a project apart.
    """
    keys = [*(graph or []), "project"]
    seen = F.lag("month").over(Window.partitionBy(*keys, *ends).orderBy("month"))
    marked = edges.select(*keys, "month", *ends).withColumn(
        "_both", F.coalesce((seen == F.col("month") - 1).cast("long"), F.lit(0)))
    sizes = marked.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("_n"), F.sum("_both").alias("_i"))
    w = Window.partitionBy(*keys).orderBy("month")
    before = F.when(F.lag("month").over(w) == F.col("month") - 1, F.lag("_n").over(w))
    return sizes.withColumn("_b", before).select(
        *keys, "month", F.when(F.col("_b").isNull(), F.lit(0.0)).otherwise(
            F.col("_i") / (F.col("_n") + F.col("_b"))).alias(alias))


def shared_devs(tech: DataFrame, social: DataFrame) -> DataFrame:
    """People that are nodes of both graphs of a month."""
    t = tech.select(*SLICE, F.col("dev").alias("node"), F.lit(1).alias("t"), F.lit(0).alias("s"))
    s = social.select(
        *SLICE, F.explode(F.array("src", "dst")).alias("node"), F.lit(0).alias("t"), F.lit(1).alias("s"))
    who = t.unionByName(s).groupBy(*SLICE, "node").agg(F.max("t").alias("t"), F.max("s").alias("s"))
    return who.groupBy(*SLICE).agg(F.sum((F.col("t") * F.col("s")).cast("long")).alias("st_num_dev"))
