"""Connected components of many graphs at once.

Each task first contracts its part of the edges to stars, at most one row per node
and task, on whole-number codes.  A graph whose stars are up to `small` rows is
finished inside one task: one shuffle by graph, no rounds.  Larger graphs go
through rounds of large-star and small-star steps (Kiveris et al., SoCC 2014),
which need a number of rounds logarithmic in the graph and never bring a whole
neighbourhood together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import HOT_ROWS, lookup
from kinweave.session import drop_table, settle, ship_functions

ship_functions(__name__)

SMALL_GRAPH = 200_000
#: Rows that a task contracts together.
HELD = 2_000_000


def _lowest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Lowest code of the component of each of n nodes, by repeated minimum over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        np.minimum.at(after, label, after)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _stars(table: pa.Table, group: list[str]) -> pa.Table:
    """(group, src, dst): each node of the edges with the lowest node of its component among them."""
    names = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[names.indices.to_numpy()]
    graph = np.zeros(table.num_rows, np.int64)
    for g in group:
        column = table.column(g).combine_chunks().dictionary_encode()
        graph = graph * (len(column.dictionary) + 1) + pc.fill_null(column.indices, len(column.dictionary)).to_numpy()
        graph = np.unique(graph, return_inverse=True)[1]
    key = np.concatenate([graph, graph]) * max(1, len(order)) + code
    nodes, first, at = np.unique(key, return_index=True, return_inverse=True)
    u, v = at[: table.num_rows], at[table.num_rows:]
    root = _lowest(u, v, len(nodes))
    sorted_names = names.dictionary.take(pa.array(order))
    name = lambda keys: sorted_names.take(pa.array(keys % max(1, len(order))))
    rows = pa.array(first % table.num_rows)
    return pa.table({**{g: table.column(g).take(rows) for g in group}, "src": name(nodes), "dst": name(nodes[root])})


def contract(edges: DataFrame, group: list[str], held: int = HELD) -> DataFrame:
    """(group, src, dst) with the same components: every task's part of the edges as stars, a lone node as a loop.

    A task contracts again whenever `held` rows have come together, and passes on what is then left of them if that is
    still half as many.
    """
    types = dict(edges.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*group, "src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= held:
                kept = _stars(pa.Table.from_batches(kept), group).to_batches()
                if 2 * sum(b.num_rows for b in kept) >= held:
                    yield from kept
                    kept = []
        if sum(b.num_rows for b in kept):
            yield from _stars(pa.Table.from_batches(kept), group).to_batches()

    return edges.select(*group, "src", "dst").mapInArrow(run, schema)


def _labels(pdf: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """Lowest node name of each node's component, by repeated minimum over the edges."""
    nodes, code = np.unique(
        np.concatenate([pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)]).astype(str),
        return_inverse=True)
    u, v = code[: len(pdf)], code[len(pdf):]
    label = _lowest(u, v, len(nodes))
    out = pd.DataFrame({"node": nodes, "component": nodes[label]})
    for i, g in enumerate(group):
        out.insert(i, g, pdf[g].iloc[0])
    return out


def star_rounds(edges: DataFrame, group: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, node, component) for graphs of any size; the component is the lowest node.

    A node whose only link goes to a lower one has the component of that one, so
    the rounds run on the links of all other nodes.  In edges that tasks have
    contracted, these are the nodes that several tasks have linked differently.
    """
    ends = F.explode(F.array(
        F.struct(F.greatest("src", "dst").alias("node"), F.when(F.col("src") != F.col("dst"), F.least("src", "dst")).alias("to")),
        F.struct(F.least("src", "dst").alias("node"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("to"))))
    linked = (F.col("src") != F.col("dst")).alias("_linked")
    rows = edges.select(*group, linked, ends.alias("e")).select(*group, "e.node", "e.to", (
        F.col("_linked") & F.col("e.to").isNull()).alias("target"))
    seen = settle(rows.groupBy(*group, "node").agg(
        F.min("to").alias("low"), F.max("to").alias("high"), F.max("target").alias("target")))
    hubs = seen.where("low <> high OR target AND low IS NOT NULL").select(*group, F.col("node").alias("src"))
    lone = ~F.col("target") & (F.col("low") == F.col("high"))
    if hubs.isEmpty():
        return seen.select(*group, "node", F.coalesce("low", "node").alias("component"))
    links = edges.where("src <> dst").select(
        *group, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).join(hubs, [*group, "src"], "left_semi")
    found = _star_rounds(settle(links.distinct()), group, hot_rows)
    asked = seen.select(*group, "node", F.when(lone, F.col("low")).otherwise(F.col("node")).alias("_at"))
    times = asked.groupBy(*group, "_at").agg(F.count(F.lit(1)).alias("_n"))
    table = times.join(found.select(*group, F.col("node").alias("_at"), "component"), [*group, "_at"])
    return lookup(asked, table, [*group, "_at"], "_n", hot_rows).select(
        *group, "node", F.coalesce("component", "_at").alias("component"))


def _star_rounds(links: DataFrame, group: list[str], hot_rows: int) -> DataFrame:
    """(group, node, component) of the nodes of distinct links whose `src` is above `dst`; the table is deleted.

    The rounds end when the links are a forest of stars: every source has one
    target and no target is a source.  Graphs that have come so far leave the
    rounds, and the tables of past rounds are deleted.
    """
    done: list[DataFrame] = []
    while not links.isEmpty():
        total = 2 * links.count()
        both = links.unionByName(links.select(*group, F.col("dst").alias("src"), F.col("src").alias("dst")))
        lowest = both.groupBy(*group, "src").agg(
            F.least(F.min("dst"), F.col("src")).alias("low"), F.count(F.lit(1)).alias("_n"))
        large = settle(
            lookup(both, lowest, [*group, "src"], "_n", hot_rows, total=total)
            .where("dst > src")
            .select(*group, F.col("dst").alias("src"), F.col("low").alias("dst")).distinct())
        lowest = large.groupBy(*group, "src").agg(
            F.min("dst").alias("low"), F.count(F.lit(1)).alias("_n"))
        moved = lookup(large, lowest, [*group, "src"], "_n", hot_rows, total=total).where("dst <> low").select(
            *group, F.col("dst").alias("src"), F.col("low").alias("dst"))
        kept = lowest.select(*group, "src", F.col("low").alias("dst"))
        after = settle(moved.unionByName(kept).distinct())
        drop_table(links)
        drop_table(large)
        links = after
        inner = links.select(*group, "src").join(
            links.select(*group, F.col("dst").alias("src")), [*group, "src"], "left_semi")
        forked = links.groupBy(*group, "src").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group, "src")
        open_nodes = inner.unionByName(forked)
        if not group:
            if open_nodes.isEmpty():
                break
            continue
        open_groups = settle(open_nodes.select(*group).distinct())
        if open_groups.isEmpty():
            break
        done.append(settle(links.join(open_groups, group, "left_anti")))
        after = settle(links.join(open_groups, group, "left_semi"))
        drop_table(links)
        drop_table(open_groups)
        links = after
    for part in done:
        links = links.unionByName(part)
    roots = links.select(*group, F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return links.select(*group, F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def connected_components(edges: DataFrame, group: list[str], small: int = SMALL_GRAPH,
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, node, component): the component is its lowest node.

    `edges` has `group`, `src`, `dst`; a node alone is given by a self loop.
    They are read once.  Rows without either end are left out.
    """
    edges = edges.select(*group, "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    edges = settle(contract(edges, group))
    if edges.count() > small:  # a footer read; with fewer rows no graph can be larger
        big = edges.groupBy(*group).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > small)
        big = settle(big.select(*group))
    else:
        big = None
    types = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = ", ".join([f"{g} {types[g]}" for g in group] + ["node string", "component string"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return _labels(pdf, group)

    if big is None or big.isEmpty():
        return edges.groupBy(*group).applyInPandas(finish, schema)
    rest = edges.join(big, group, "left_anti")
    wide = settle(edges.join(big, group, "left_semi"))
    return rest.groupBy(*group).applyInPandas(finish, schema).unionByName(
        star_rounds(wide, group, hot_rows))
