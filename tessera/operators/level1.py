"""Vector operators on Vec DataFrames (i, v).

Elements are doubles; vectors of an operator have the same indices.  Single-precision inputs are widened before any arithmetic.
Reductions give the clean value (0 for no elements), never an addition to an earlier result.  ``*_value`` forms run a job and
return a Python number; all others are lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import givens
from tessera.functions.scalar import REDUCTIONS, arg_max, arg_min


def _pair(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.select("i", F.col("v").alias("x")).join(y.select("i", F.col("v").alias("y")), "i")


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    return _pair(x, y).select("i", (F.lit(float(alpha)) * F.col("x") + F.col("y")).alias("v"))


def copy(x: DataFrame) -> DataFrame:
    return x.select("i", "v")


def swap(x: DataFrame, y: DataFrame) -> DataFrame:
    """i, x, y: the two vectors exchanged, in one pass."""
    return _pair(x, y).select("i", F.col("y").alias("x"), F.col("x").alias("y"))


def scal(alpha: float, x: DataFrame) -> DataFrame:
    """A zero factor writes zeros, whatever the elements are."""
    return x.select("i", (F.lit(0.0) if alpha == 0 else F.lit(float(alpha)) * F.col("v")).alias("v"))


def scal_matrix(alpha: float, a: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "v"]
    if alpha == 1:
        return a.select(*keys, "v")
    return a.select(*keys, (F.lit(0.0) if alpha == 0 else F.lit(float(alpha)) * F.col("v")).alias("v"))


def scal_complex(alpha: complex, x: DataFrame) -> DataFrame:
    """On (i, v struct<re, im>)."""
    re, im, a = F.col("v.re"), F.col("v.im"), complex(alpha)
    if a == 0:
        return x.select("i", F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).alias("v"))
    return x.select("i", F.struct((re * a.real - im * a.imag).alias("re"), (re * a.imag + im * a.real).alias("im")).alias("v"))


def rot(x: DataFrame, y: DataFrame, c: float, s: float) -> DataFrame:
    """i, x, y after the plane rotation."""
    px, py, c, s = F.col("x"), F.col("y"), float(c), float(s)
    return _pair(x, y).select("i", (c * px + s * py).alias("x"), (-s * px + c * py).alias("y"))


def rotm(x: DataFrame, y: DataFrame, param: list[float]) -> DataFrame:
    h11, h12, h21, h22 = givens.rotm_matrix(param)
    px, py = F.col("x"), F.col("y")
    return _pair(x, y).select("i", (h11 * px + h12 * py).alias("x"), (h21 * px + h22 * py).alias("y"))


def rotg(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The rows with r, z, c, s for their (a, b)."""
    return pairs.withColumns(givens.rotg(F.col(a), F.col(b)))


def rotmg(rows: DataFrame, d1: str = "d1", d2: str = "d2", x1: str = "x1", y1: str = "y1", out: str = "rotmg") -> DataFrame:
    """The rows with the struct ``givens.ROTMG``."""
    return rows.withColumn(out, givens.rotmg(F.col(d1), F.col(d2), F.col(x1), F.col(y1)))


def _one(x: DataFrame, value: Column, name: str = "v") -> DataFrame:
    return x.agg(value.alias(name))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return _one(_pair(x, y), REDUCTIONS["add"](F.col("x") * F.col("y")))


def sdsdot(sb: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """sb plus the dot product of single-precision vectors, accumulated in double precision and rounded to single at the end."""
    px, py = F.col("x").cast("float").cast("double"), F.col("y").cast("float").cast("double")
    return _one(_pair(x, y), (F.lit(float(sb)) + REDUCTIONS["add"](px * py)).cast("float"))


def asum(x: DataFrame) -> DataFrame:
    return _one(x, REDUCTIONS["absadd"](F.col("v")))


def nrm2(x: DataFrame) -> DataFrame:
    return _one(x, F.sqrt(REDUCTIONS["add"](F.col("v") * F.col("v"))))


def iamax(x: DataFrame) -> DataFrame:
    return _one(x, arg_max(F.col("i"), F.col("v")))


def iamin(x: DataFrame) -> DataFrame:
    return _one(x, arg_min(F.col("i"), F.col("v")))


def value(result: DataFrame):
    """The number of a one-row result."""
    return result.first()[0]
