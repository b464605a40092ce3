"""Rows with usable vectors, and their Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.session import ship_functions

ship_functions(__name__)


def finite(vec: Column) -> Column:
    """True where a vector is given and all its entries are finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def usable(rows: DataFrame, vec_col: str, *more: Column) -> DataFrame:
    """`more` and `_kw_vec array<double>` of the rows whose vector is finite."""
    vec = F.col(vec_col).cast("array<double>")
    return rows.where(finite(vec)).select(*more, vec.alias("_kw_vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch of lists of one length, without nulls, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
