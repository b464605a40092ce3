"""Line dedup over levelled sorted runs of line hashes.

`LineRuns` keeps, per line key, in how many documents it stood.  A batch is
counted, loses the keys that the runs already hold as settled (merge anti-join),
and its own counts are written as a sorted run of level 0.  When a level has
`fan_in` runs they are merged into one run of the next level.  All of it is
DataFrame work; the driver holds only the list of runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.session import drop_table, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["_kw_a", "_kw_b"]


def line_key(line: Column) -> Column:
    """The line without white space `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits: two 64-bit hashes of differently begun strings."""
    return F.struct(F.xxhash64(key).alias("_kw_a"), F.xxhash64(F.lit("line"), key).alias("_kw_b"))


def lines_of(text: Column) -> Column:
    """All lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes_of(lines: Column, min_chars: int) -> Column:
    """The distinct key hashes of those lines that may be dropped."""
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)
    return F.transform(F.array_distinct(keys), key_hash)


@dataclass
class LineRuns:
    """Sorted runs (hash, documents) by level; `settled` is the count from which a key need not be counted on."""

    spark: SparkSession
    settled: int = 1
    fan_in: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)

    def _write(self, counts: DataFrame) -> DataFrame:
        return settle(counts.repartition(*KEY).sortWithinPartitions(*KEY))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame:
        """(hash, n) over all runs; empty without any."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "_kw_a long, _kw_b long, n long")
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy(*KEY).agg(F.sum("n").alias("n")) if len(runs) > 1 else out

    def fresh(self, counts: DataFrame) -> DataFrame:
        """The rows of `counts` (hash, ...) whose key is not settled in the runs."""
        return counts.join(self.merged().where(F.col("n") >= self.settled).select(*KEY), KEY, "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Merge-anti-join a batch of (hash, n) with the runs and add the rest as a run."""
        if self.runs():
            counts = self.fresh(counts)
        run, level = self._write(counts.select(*KEY, "n")), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for part in old[1:]:
                merged = merged.unionByName(part)
            run, level = self._write(merged.groupBy(*KEY).agg(F.sum("n").alias("n"))), level + 1
            for part in old:
                drop_table(part)

    def drop(self) -> None:
        for run in self.runs():
            drop_table(run)
        self.levels = []


def count_lines(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(hash, n): in how many rows each droppable line key stands."""
    return (
        docs.select(F.explode(hashes_of(lines_of(F.col(text)), min_chars)).alias("_kw_k"))
        .select("_kw_k.*").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10,
                        min_chars: int = 1, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """`docs` with kept_text, n_lines, n_dropped: without the lines whose key stands in `min_docs` rows or more.

    Texts are cut at newlines; a null or empty text has one empty line, and its
    kept_text is empty.  Keys shorter than `min_chars` code points always stay.
    Every row counts as a document, repeated rows too; rows with one id, or a
    null id, are told apart by nothing, and none needs to be.  Columns of `docs`
    named kept_text, n_lines or n_dropped are replaced; an empty table gives an
    empty one.

    The rows come in `batches` by a hash of their id.  A key that has reached
    `min_docs` in the runs is settled and its later lines are not counted on.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    batch = F.pmod(F.xxhash64(id_col), F.lit(batches)).cast("int")
    counted = settle(
        docs.select(batch.alias("_kw_batch"), F.explode(hashes_of(lines_of(F.col(text)), min_chars)).alias("_kw_k"))
        .select("_kw_batch", "_kw_k.*").groupBy("_kw_batch", *KEY).agg(F.count(F.lit(1)).alias("n")))
    runs = LineRuns(spark, settled=min_docs, fan_in=fan_in)
    for k in range(batches):
        runs.add(counted.where(F.col("_kw_batch") == k))
    frequent = settle(runs.merged().where(F.col("n") >= min_docs).select(*KEY))
    runs.drop()
    drop_table(counted)
    hit = (
        docs.select(F.col(id_col).alias("_kw_id"), F.explode(hashes_of(lines_of(F.col(text)), min_chars)).alias("_kw_k"))
        .select("_kw_id", "_kw_k.*").join(frequent, KEY, "left_semi")
        .groupBy("_kw_id").agg(F.collect_set(F.struct(*KEY)).alias("_kw_gone")))
    lines = lines_of(F.col(text))
    gone = F.coalesce("_kw_gone", F.array().cast("array<struct<_kw_a:bigint,_kw_b:bigint>>"))
    rest = F.when(F.size(gone) == 0, lines).otherwise(F.filter(lines, lambda line: ~(
        (F.length(line_key(line)) >= min_chars) & F.array_contains(gone, key_hash(line_key(line))))))
    joined = docs.join(hit, docs[id_col].eqNullSafe(hit["_kw_id"]), "left")
    return joined.withColumn("_kw_rest", rest).select(
        *docs.columns, F.array_join("_kw_rest", "\n").alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("_kw_rest")).cast("long").alias("n_dropped"))
