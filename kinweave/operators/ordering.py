"""Ordered work inside groups of any size.

A window puts each group into one task.  That is fine where the calendar bounds
the group (months of a project), but not for a thread or a label that may hold a
third of all rows.  Here rows are range-partitioned by (group, order), so one
group may span many slices; each slice works on its own and only one summary row
per (group, slice) crosses slice borders.  The sliced rows are written to the
shared folder first, so every branch of the plan sees the same slice borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.session import settle

SLICE = "_slice"


def sliced(df: DataFrame, by: list[str], slices: int | None = None) -> DataFrame:
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(slices, *by).withColumn(SLICE, F.spark_partition_id()))


def _with_carry(parts: DataFrame, group: list[str], summary: Column, carry) -> DataFrame:
    """Join `carry(summary)` of the earlier slices of a group to its rows."""
    ends = parts.groupBy(*group, SLICE).agg(summary.alias("_end"))
    across = Window.partitionBy(*group).orderBy(SLICE)
    ends = ends.select(*group, SLICE, carry(across).alias("_carry"))
    return parts.join(ends, [*group, SLICE], "left")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, alias: str,
                slices: int | None = None) -> DataFrame:
    """Sum of `value` over the group's rows up to and including this one."""
    parts = sliced(df, group + order, slices)
    rows = _with_carry(
        parts, group, F.sum(value),
        lambda w: F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    inside = Window.partitionBy(*group, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(inside) + F.coalesce("_carry", F.lit(0))
    return rows.withColumn(alias, total).drop("_carry", SLICE)


def row_numbers(df: DataFrame, group: list[str], order: list[str], alias: str = "rank",
                slices: int | None = None) -> DataFrame:
    """Position of each row in its group, from 1."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, group, order, "_one", alias, slices).drop("_one")


def previous(df: DataFrame, group: list[str], order: list[str], value: str, alias: str,
             slices: int | None = None) -> DataFrame:
    """`value` of the row before this one in its group, null for the first."""
    parts = sliced(df, group + order, slices)
    rows = _with_carry(
        parts, group, F.max_by(value, F.struct(*order)), lambda w: F.lag("_end").over(w)
    )
    inside = Window.partitionBy(*group, SLICE).orderBy(*order)
    first = F.row_number().over(inside) == 1
    before = F.when(first, F.col("_carry")).otherwise(F.lag(value).over(inside))
    return rows.withColumn(alias, before).drop("_carry", SLICE)
