"""Exact dedup by composable polynomial fingerprints.

The bytes of a text are the digits, in base 256, of a number; its remainders by
two primes are the fingerprint.  Chunks are hashed apart from each other and
composed: H(ab) = H(a) * 256^|b| + H(b).  Rows of equal fingerprint and length
are then compared chunk by chunk with the row that would stay, so a collision
never drops a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.session import drop_table, settle, ship_functions

ship_functions(__name__)

#: The two largest primes below 2^30: products of remainders fit in a long.
PRIMES = (1073741789, 1073741783)
#: Code points of a chunk.
CHUNK = 1 << 18
KEY = ["_kw_bytes", "_kw_h0", "_kw_h1"]


def chunk_hash(data: bytes, primes: tuple[int, int] = PRIMES) -> tuple[int, int, int, int]:
    """(h0, h1, s0, s1): remainders of the bytes as a number, and the shifts 256^len."""
    number = int.from_bytes(data, "big")
    return (number % primes[0], number % primes[1], pow(256, len(data), primes[0]), pow(256, len(data), primes[1]))


def compose(chunks: Column, primes: tuple[int, int] = PRIMES) -> Column:
    """(h0, h1) of an ordered array of structs with h0, h1, s0, s1."""
    start = F.struct(F.lit(0).cast("long").alias("h0"), F.lit(0).cast("long").alias("h1"))
    return F.aggregate(chunks, start, lambda acc, c: F.struct(
        ((acc["h0"] * c["s0"] + c["h0"]) % primes[0]).alias("h0"),
        ((acc["h1"] * c["s1"] + c["h1"]) % primes[1]).alias("h1")))


def chunks_of(text: Column, size: int) -> Column:
    """Array of (no, chunk): consecutive substrings of `size` code points; one empty chunk for an empty text."""
    return F.when(F.length(text) <= size, F.array(F.struct(F.lit(0).alias("no"), text.alias("chunk")))).otherwise(
        F.transform(F.sequence(F.lit(0), ((F.length(text) - 1) / size).cast("int")), lambda i: F.struct(
            i.alias("no"), F.substring(text, i * size + 1, F.lit(size)).alias("chunk"))))


def fingerprints(docs: DataFrame, id_col: str, text: str, chunk: int, primes: tuple[int, int]) -> DataFrame:
    """One row per (id, text): _kw_id, _kw_sha, _kw_rows, _kw_chunks and the fingerprint with the length in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4
        for batch in batches:
            found = [chunk_hash(x.as_buffer().to_pybytes(), primes) for x in batch.column("chunk").cast(pa.binary())]
            columns = list(zip(*found)) if found else [()] * 4
            keep = [c for c in batch.schema.names if c != "chunk"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=keep + ["h0", "h1", "s0", "s1"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_kw_id"), whole.alias("_kw_text"))
    cut = rows.select(
        "_kw_id", F.sha2(F.encode("_kw_text", "utf-8"), 256).alias("_kw_sha"),
        F.octet_length("_kw_text").cast("long").alias("_kw_bytes"),
        F.explode(chunks_of(F.col("_kw_text"), chunk)).alias("_kw_c")).select("_kw_id", "_kw_sha", "_kw_bytes", "_kw_c.*")
    kind = dict(cut.dtypes)["_kw_id"]
    hashed = cut.mapInArrow(run, f"_kw_id {kind}, _kw_sha string, _kw_bytes long, no int, h0 long, h1 long, s0 long, s1 long")
    grouped = hashed.groupBy("_kw_id", "_kw_sha", "_kw_bytes").agg(
        F.array_sort(F.collect_set(F.struct("no", "h0", "h1", "s0", "s1"))).alias("_kw_parts"),
        F.sum((F.col("no") == 0).cast("long")).alias("_kw_rows"))
    both = compose(F.col("_kw_parts"), primes)
    return grouped.select(
        "_kw_id", "_kw_sha", "_kw_bytes", "_kw_rows", F.size("_kw_parts").alias("_kw_chunks"), both.alias("_kw_f")).select(
        "_kw_id", "_kw_sha", "_kw_bytes", "_kw_rows", "_kw_chunks",
        F.col("_kw_f.h0").alias("_kw_h0"), F.col("_kw_f.h1").alias("_kw_h1"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK,
           primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per (id, text): _kw_id, _kw_sha, _kw_rows, _kw_keep, _kw_size.

    `_kw_rows` counts repeated rows of one id and text, `_kw_size` the rows of the
    group, `_kw_keep` is its largest id (null only if all are).
    """
    rows = settle(fingerprints(docs, id_col, text, chunk, primes))
    rep = F.max(F.struct("_kw_id", "_kw_sha")).alias("_kw_rep")
    first = rows.groupBy(*KEY).agg(rep, F.count(F.lit(1)).alias("_kw_n"))
    alone = rows.join(first.where("_kw_n = 1").select(*KEY), KEY, "left_semi").select(
        "_kw_id", "_kw_sha", "_kw_rows", F.col("_kw_id").alias("_kw_keep"), F.col("_kw_sha").alias("_kw_of"))
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_kw_tid"), whole.alias("_kw_text")).withColumn(
        "_kw_tsha", F.sha2(F.encode("_kw_text", "utf-8"), 256))
    open_rows = settle(rows.join(first.where("_kw_n > 1").select(*KEY), KEY, "left_semi"))
    done = [alone]
    chunks = None
    while not open_rows.isEmpty():
        if chunks is None:  # the chunks of all rows that share a fingerprint
            part = open_rows.select("_kw_id", "_kw_sha", *KEY)
            chunks = settle(
                texts.join(part.hint("merge"), _same("_kw_tid", "_kw_id") & (F.col("_kw_tsha") == F.col("_kw_sha")))
                .select("_kw_id", "_kw_sha", *KEY, F.explode(chunks_of(F.col("_kw_text"), chunk)).alias("_kw_c"))
                .select("_kw_id", "_kw_sha", *KEY, F.col("_kw_c.no").alias("_kw_no"), F.col("_kw_c.chunk").alias("_kw_chunk")))
        reps = settle(open_rows.groupBy(*KEY).agg(rep).select(
            *KEY, F.col("_kw_rep._kw_id").alias("_kw_keep"), F.col("_kw_rep._kw_sha").alias("_kw_of")))
        held = reps.select(F.col("_kw_keep").alias("_kw_id"), F.col("_kw_of").alias("_kw_sha"), *KEY)
        kept = chunks.join(held, _on(chunks, held), "left_semi").dropDuplicates([*KEY, "_kw_no"]).select(
            *KEY, "_kw_no", F.col("_kw_chunk").alias("_kw_rep_chunk"))
        still = chunks.join(open_rows.select("_kw_id", "_kw_sha", *KEY), _on(chunks, open_rows), "left_semi")
        equal = (
            still.join(kept, [*KEY, "_kw_no"]).where("_kw_chunk = _kw_rep_chunk")
            .groupBy("_kw_id", "_kw_sha", *KEY).agg(F.count_distinct("_kw_no").alias("_kw_equal")))
        compared = settle(open_rows.join(equal, _on(open_rows, equal), "left").select(
            *[open_rows[c] for c in open_rows.columns], "_kw_equal").join(reps, KEY))
        same = F.coalesce(F.col("_kw_equal"), F.lit(0)) == F.col("_kw_chunks")
        done.append(compared.where(same).select("_kw_id", "_kw_sha", "_kw_rows", "_kw_keep", "_kw_of"))
        after = settle(compared.where(~same).select(*open_rows.columns))
        drop_table(open_rows)
        drop_table(reps)
        open_rows = after
    if chunks is not None:
        drop_table(chunks)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = settle(out)
    sizes = out.groupBy("_kw_of", "_kw_keep").agg(F.sum("_kw_rows").alias("_kw_size"))
    sizes = sizes.select(F.col("_kw_of").alias("_kw_o"), F.col("_kw_keep").alias("_kw_k"), "_kw_size")
    return out.join(sizes, (F.col("_kw_of") == F.col("_kw_o")) & _same("_kw_keep", "_kw_k")).select(
        "_kw_id", "_kw_sha", "_kw_rows", "_kw_keep", "_kw_size")


def _on(left: DataFrame, right: DataFrame) -> Column:
    on = left["_kw_id"].eqNullSafe(right["_kw_id"]) & (left["_kw_sha"] == right["_kw_sha"])
    for key in KEY:
        on = on & (left[key] == right[key])
    return on


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                 primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of `docs`.

    Texts are equal when identical; null counts as empty.  The row with the
    largest id of a group stays; of repeated rows with that id one stays.  Null
    ids are smallest.  Other columns are left out; an empty table gives an empty
    one.
    """
    found = groups(docs, id_col, text, chunk, primes)
    return found.withColumn("_kw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_kw_rows")))).select(
        F.col("_kw_id").alias("doc_id"), F.col("_kw_keep").alias("keep_id"), F.col("_kw_size").alias("group_size"),
        (_same("_kw_id", "_kw_keep") & (F.col("_kw_copy") == 1)).alias("kept"), F.col("_kw_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """`docs` without all but one row of each group of equal texts, all columns kept."""
    found = settle(groups(docs, id_col, text, chunk).where(_same("_kw_id", "_kw_keep")).select("_kw_id", "_kw_sha", "_kw_rows"))
    sha = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"), 256)
    tagged = docs.withColumn("_kw_tsha", sha)
    on = tagged[id_col].eqNullSafe(found["_kw_id"]) & (tagged["_kw_tsha"] == found["_kw_sha"])
    if found.where("_kw_rows > 1").isEmpty():
        return tagged.join(found.hint("merge"), on, "left_semi").drop("_kw_tsha")
    joined = tagged.join(found.hint("merge"), on)
    once = joined.where("_kw_rows = 1").select(*docs.columns)
    repeated = joined.where("_kw_rows > 1").dropDuplicates([id_col, "_kw_tsha"]).select(*docs.columns)
    return once.unionByName(repeated)
