"""Extension operators: batched axpy, copies, sums and transposes of matrices, and reductions along one dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import REDUCTIONS
from tessera.plans import views
from tessera.schema import transposed


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("b", "i", "j") if c in df.columns]


def _scaled(alpha: float, df: DataFrame) -> DataFrame:
    if alpha == 1:
        return df.select(*_keys(df), "v")
    return df.select(*_keys(df), (F.lit(0.0) if alpha == 0 else F.lit(float(alpha)) * F.col("v")).alias("v"))


def axpy_batch(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """On (b, i, v); an x without ``b`` (stride 0) is shared by the batch."""
    on = [c for c in ("b", "i") if c in x.columns]
    return y.join(x.select(*on, F.col("v").alias("x")), on).select("b", "i", (F.lit(float(alpha)) * F.col("x") + F.col("v")).alias("v"))


def omatcopy(trans: str, alpha: float, a: DataFrame) -> DataFrame:
    """alpha op(A)."""
    return _scaled(alpha, views.transpose(a) if transposed(trans) else a)


def omatcopy_batch(trans: str, alpha: float, a: DataFrame) -> DataFrame:
    return omatcopy(trans, alpha, a)


def imatcopy_batch(trans: str, alpha: float, a: DataFrame) -> DataFrame:
    """The new contents; DataFrames don't change in place."""
    return omatcopy(trans, alpha, a)


def omatadd(transa: str, transb: str, alpha: float, a: DataFrame, beta: float, b: DataFrame) -> DataFrame:
    """alpha op(A) + beta op(B)."""
    left, right = omatcopy(transa, alpha, a), omatcopy(transb, beta, b)
    keys = _keys(left)
    return left.join(right.withColumnRenamed("v", "w"), keys).select(*keys, (F.col("v") + F.col("w")).alias("v"))


def omatadd_batch(transa: str, transb: str, alpha: float, a: DataFrame, beta: float, b: DataFrame) -> DataFrame:
    return omatadd(transa, transb, alpha, a, beta, b)


def transpose(a: DataFrame) -> DataFrame:
    return views.transpose(a)


def reduction(op: str, dimension: str, a: DataFrame) -> DataFrame:
    """``inner`` reduces the rows of every column to one element (indexed by column), ``outer`` the columns of every row."""
    if op not in REDUCTIONS:
        raise ValueError(f"unknown reduction {op!r}")
    if dimension not in ("inner", "outer"):
        raise ValueError(f"unknown dimension {dimension!r}")
    return a.groupBy(F.col("j" if dimension == "inner" else "i").alias("i")).agg(REDUCTIONS[op](F.col("v")).alias("v"))
