"""Embedding columns as double-precision matrices, and their valid rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there, not zero, and holds only finite numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def dimensions(df: DataFrame, vector: str) -> list[int]:
    """The dimensions of the usable vectors, ascending: a row per dimension reaches the driver."""
    return sorted(r["d"] for r in df.filter(usable(vector)).select(F.size(vector).alias("d")).distinct().collect())


def of_dimension(df: DataFrame, vector: str, d: int) -> DataFrame:
    """The usable vectors of one dimension."""
    return df.filter(usable(vector) & (F.size(vector) == d))


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))
