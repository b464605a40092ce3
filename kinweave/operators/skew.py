"""Joining a long table to one row per key when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import settle

# A key with more rows than this is hot.
HOT_ROWS = 2_000_000
# A lookup table of up to this many rows is broadcast whole.
BROADCAST_ROWS = 200_000


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    weight: str,
    hot_rows: int = HOT_ROWS,
    spread: int | None = None,
    total: int | None = None,
    settled: bool = False,
) -> DataFrame:
    """Left join of `rows` to `table`, which has one row per key of `on`.

    `table[weight]` is the number of rows `rows` has for that key.  The table is
    settled and its rows counted.  A small one is broadcast, so `rows` are not
    shuffled.  Otherwise keys above `hot_rows`, at most `len(rows) / hot_rows` of
    them, are broadcast and their rows spread over many tasks by a salt, while
    all other keys meet in an ordinary shuffle join.

    With a known `total` of rows up to `hot_rows` no key can be hot, and a plain
    join does.
    """
    if total is not None and total <= hot_rows:
        return rows.join(table.drop(weight), on, "left")
    if not settled:
        table = settle(table)
    if table.count() <= min(BROADCAST_ROWS, hot_rows):
        return rows.join(F.broadcast(table.drop(weight)), on, "left")
    spread = spread or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in table.columns if c not in on and c != weight]
    payload = F.struct(*values)
    hot = table.where(F.col(weight) > hot_rows).select(*on, payload.alias("_hot"))
    cold = table.where(F.col(weight) <= hot_rows).select(
        *on, F.lit(0).cast("long").alias("_salt"), payload.alias("_cold")
    )
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(
        1 + F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    )
    found = F.coalesce("_cold", "_hot")
    return (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", salt)
        .join(cold, [*on, "_salt"], "left")
        .select(*rows.columns, *[found[v].alias(v) for v in values])
    )
