"""Approximate nearest neighbours by largest inner product: a robust-pruned graph per shard, searched by beams.

Equal vectors are one point with its smallest ids.  Points are dealt to shards of
about `SHARD_ROWS` by a hash of the vector; each shard is one graph
(`graph_index`).  A coordinate more, the square root of what the squared norm lacks
to the largest of the shard, turns the largest inner product into the least
distance.  Every query runs through every shard, in blocks; what the beams found
is scored again in double precision on the given vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.graph_index import BUILD_BEAM, DEGREE, NONE, Graph, beam_search, build
from kinweave.llm.vectors import usable
from kinweave.session import settle, ship_functions

ship_functions(__name__)

#: Points of a shard and queries of a block, about; nodes that a beam holds.
SHARD_ROWS, BLOCK_ROWS, BEAM = 16_384, 1024, 160
#: Queries whose candidates are scored together.
TOGETHER = 128
#: Ways a vector that many rows share is summed up before its rows meet.
SALTS = 64


def _packed(rows: DataFrame, vec_col: str, *more: Column) -> DataFrame:
    """`more`, dim and the vector as a binary of doubles, of rows with a finite vector that is not zero."""
    good = usable(rows, vec_col, *more).where(F.exists("_kw_vec", lambda x: x != 0))
    names = good.columns[:-1]
    schema = ", ".join(f"{name} {kind}" for name, kind in good.dtypes[:-1]) + ", dim int, vec binary"

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            at = lists.offsets.to_numpy()
            raw = (lists.values.to_numpy(zero_copy_only=False) + 0.0).astype("<f8").tobytes()  # no negative zero
            offsets = pa.py_buffer((at * 8).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(at).astype(np.int32)), packed], names=[*names, "dim", "vec"])

    return good.mapInArrow(run, schema)


def points_of(rows: DataFrame, id_col: str, vec_col: str, keep: int) -> DataFrame:
    """(dim, vec, ids): each distinct vector with its `keep` smallest ids; more of them can be nobody's nearest.

    A vector that many rows share is summed up per batch, then per salt.
    """
    kind = dict(rows.dtypes)[id_col]
    packed = _packed(rows.where(F.col(id_col).isNotNull()), vec_col, F.col(id_col).alias("id"))

    def first_ids(batches):
        for batch in batches:
            held: dict[bytes, set] = {}
            for vec, one in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist()):
                held.setdefault(vec, set()).add(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) // 8 for v in held], pa.int32()), pa.array(list(held), pa.binary()),
                 pa.array([sorted(x)[:keep] for x in held.values()], pa.list_(batch.column(0).type))], names=["dim", "vec", "ids"])

    def least(of: str) -> Column:
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(of)))), 1, keep).alias(of)

    some = packed.mapInArrow(first_ids, f"dim int, vec binary, ids array<{kind}>")
    salted = some.groupBy("dim", "vec", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(least("ids"))
    return salted.groupBy("dim", "vec").agg(least("ids"))


def build_index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS,
                degree: int = DEGREE, beam: int = BUILD_BEAM) -> DataFrame:
    """(dim, shard, node, entry, ids, vec, edges): one row per distinct vector, for searches of up to `k` neighbours.

    Null, zero and non-finite vectors and rows without an id are left out, as are
    other columns; vectors of different length stand in different shards; of equal
    vectors the k + 1 smallest ids are kept.  An empty table gives an empty index.
    The index is a table in the shared folder.
    """
    points = settle(points_of(rows, id_col, vec_col, k + 1))
    shards = settle(points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")))
    dealt = points.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int")).drop("shards")
    kind = dict(rows.dtypes)[id_col]

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec")  # a repeated task builds the same graph
        dim = table.column("dim")[0].as_py()
        g = build(_reduced(_vectors(table, dim)), degree, beam)
        offsets = np.arange(len(g.edges) + 1, dtype=np.int32) * g.edges.shape[1]
        return pa.table({
            "dim": table.column("dim"), "shard": table.column("shard"), "node": pa.array(np.arange(len(g.edges)), pa.int32()),
            "entry": pa.array(np.isin(np.arange(len(g.edges)), g.entries)), "ids": table.column("ids"), "vec": table.column("vec"),
            "edges": pa.ListArray.from_arrays(offsets, g.edges.ravel())})

    return settle(dealt.groupBy("dim", "shard").applyInArrow(
        graph, f"dim int, shard int, node int, entry boolean, ids array<{kind}>, vec binary, edges array<int>"))


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f8").reshape(-1, dim)


def _reduced(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled to norms of up to 1, and what their squared norms lack to 1 as a coordinate more."""
    v = vectors / np.abs(vectors).max()
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v, norm = v / norm.max(), norm / norm.max()
    return np.column_stack([v, np.sqrt(np.maximum(0.0, 1 - norm * norm))]).astype(np.float32)


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in the space of `_reduced`."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.column_stack([v, np.zeros(len(v))]).astype(np.float32)


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           beam: int = BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest that were found for each query, its own id left out.

    The score is the inner product in double precision; ties go to the smaller id.
    Queries without an id or a finite vector that is not zero have no rows; repeated rows count
    once; rows of one id with different vectors are ranked each for itself.  Every
    shard of a query's length is searched; shards of up to `beam` points wholly.
    """
    kind = dict(queries.dtypes)[id_col]
    if dict(index.dtypes)["ids"] != f"array<{kind}>":
        raise ValueError("ids of the queries and of the index differ in type")
    asked = settle(_packed(queries.where(F.col(id_col).isNotNull()), vec_col, F.col(id_col).alias("query_id")).distinct())
    parts = max(1, -(-asked.count() // block_rows))  # a footer read
    shards = index.select(F.col("dim").alias("shard_dim"), F.col("shard").alias("shard_no")).distinct()
    key = F.xxhash64("vec").alias("query_key")
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id", "vec"), F.lit(parts)).cast("int")).select("*", key)
    dealt = dealt.join(shards, F.col("dim") == F.col("shard_dim")).withColumnRenamed("shard_no", "shard")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": left.column("query_id").slice(0, 0), "query_key": pa.array([], pa.int64()),
                 "vec_id": left.column("query_id").slice(0, 0), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        right = right.sort_by("node")
        dim = right.column("dim")[0].as_py()
        points = _vectors(right, dim)
        edges = right.column("edges").combine_chunks().flatten().to_numpy().reshape(len(points), -1)
        ids = right.column("ids").combine_chunks()
        many = np.diff(ids.offsets.to_numpy())
        begin, flat = ids.offsets.to_numpy()[:-1], ids.values
        rank_of = np.argsort(np.argsort(flat.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")  # ids in order
        vectors = _vectors(left, dim)
        distinct, of = np.unique(vectors, axis=0, return_inverse=True)
        entries = np.flatnonzero(right.column("entry").to_numpy())
        nodes, _ = beam_search(Graph(_reduced(points), edges, entries), _directions(distinct), beam)
        own = left.column("query_id").combine_chunks().to_numpy(zero_copy_only=False)
        names = flat.to_numpy(zero_copy_only=False)
        rows, hits, scores = [], [], []
        for first in range(0, len(vectors), TOGETHER):
            some = np.arange(first, min(first + TOGETHER, len(vectors)))
            q, slot = np.nonzero(nodes[of[some]] != NONE)
            node = nodes[of[some]][q, slot]
            score = np.einsum("ij,ij->i", points[node], vectors[some][q])
            repeat = many[node]
            at = np.repeat(begin[node] - np.cumsum(repeat) + repeat, repeat) + np.arange(repeat.sum())
            q, score = np.repeat(q, repeat), np.repeat(score, repeat)
            other = names[at] != own[some][q]
            q, score, at = q[other], score[other], at[other]
            order = np.lexsort((rank_of[at], -score, q))
            q, score, at = q[order], score[order], at[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            near = place < k
            rows.append(some[q[near]])
            hits.append(at[near])
            scores.append(score[near])
        row, hit = np.concatenate(rows), np.concatenate(hits)
        return pa.table({"query_id": left.column("query_id").take(pa.array(row)), "query_key": left.column("query_key").take(pa.array(row)),
                         "vec_id": flat.take(pa.array(hit)), "score": pa.array(np.concatenate(scores))})

    groups = ["dim", "shard", "part"]
    found = dealt.groupBy(*groups).cogroup(copies.groupBy(*groups)).applyInArrow(
        block, f"query_id {kind}, query_key long, vec_id {kind}, score double")
    nearest = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
