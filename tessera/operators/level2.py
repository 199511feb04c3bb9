"""Matrix-vector operators on Mat (i, j, v) and Vec (i, v).

A product is an equi-join on the contracted index and a grouped sum with map-side combining; transposing renames columns.
Catalyst broadcasts the vector where its size allows and shuffles otherwise.  ``beta == 0`` never reads y.  Band and packed forms
take matrices as their views decode them (``tessera.plans.views``); triangles and bands are cut before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.solve import solve_vector
from tessera.plans.views import band, in_triangle, mirror, transpose, triangle
from tessera.schema import flag, transposed


def _product(a: DataFrame, x: DataFrame) -> DataFrame:
    """i, p: sums of a_ij * x_j."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("p"))


def _combined(alpha: float, product: DataFrame, beta: float, y: DataFrame | None) -> DataFrame:
    p = F.lit(float(alpha)) * F.col("p")
    if beta == 0 or y is None:
        return product.select("i", p.alias("v"))
    return y.join(product, "i", "left").select("i", (F.coalesce(p, F.lit(0.0)) + F.lit(float(beta)) * F.col("v")).alias("v"))


def gemv(trans: str, alpha: float, a: DataFrame, x: DataFrame, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    return _combined(alpha, _product(transpose(a) if transposed(trans) else a, x), beta, y)


def _check_band(m: int, n: int, kl: int, ku: int) -> None:
    if not 0 <= kl < m or not 0 <= ku < n:
        raise ValueError("kl must be less than m, and ku than n")


def gbmv(trans: str, m: int, n: int, kl: int, ku: int, alpha: float, a: DataFrame, x: DataFrame, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    _check_band(m, n, kl, ku)
    return gemv(trans, alpha, band(a, kl, ku), x, beta, y)


def symv(uplo: str, alpha: float, a: DataFrame, x: DataFrame, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    return _combined(alpha, _product(mirror(a, uplo), x), beta, y)


def sbmv(uplo: str, n: int, k: int, alpha: float, a: DataFrame, x: DataFrame, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    _check_band(n, n, k, k)
    return symv(uplo, alpha, band(a, k, k), x, beta, y)


def spmv(uplo: str, alpha: float, a: DataFrame, x: DataFrame, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    return symv(uplo, alpha, a, x, beta, y)


def trmv(uplo: str, trans: str, diag: str, a: DataFrame, x: DataFrame) -> DataFrame:
    t = triangle(a, uplo, diag)
    return _combined(1.0, _product(transpose(t) if transposed(trans) else t, x), 0.0, None)


def tbmv(uplo: str, trans: str, diag: str, n: int, k: int, a: DataFrame, x: DataFrame) -> DataFrame:
    _check_band(n, n, k, k)
    return trmv(uplo, trans, diag, band(a, k, k), x)


def tpmv(uplo: str, trans: str, diag: str, a: DataFrame, x: DataFrame) -> DataFrame:
    return trmv(uplo, trans, diag, a, x)


def trsv(uplo: str, trans: str, diag: str, n: int, a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """x of op(A) x = b."""
    return solve_vector(uplo, trans, diag, n, a, b, block)


def tbsv(uplo: str, trans: str, diag: str, n: int, k: int, a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    _check_band(n, n, k, k)
    return solve_vector(uplo, trans, diag, n, band(a, k, k), b, block)


def tpsv(uplo: str, trans: str, diag: str, n: int, a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    return solve_vector(uplo, trans, diag, n, a, b, block)


def _with(a: DataFrame, x: DataFrame, key: str, name: str) -> DataFrame:
    return a.join(x.select(F.col("i").alias(key), F.col("v").alias(name)), key)


def ger(alpha: float, x: DataFrame, y: DataFrame, a: DataFrame) -> DataFrame:
    return _with(_with(a, x, "i", "x"), y, "j", "y").select("i", "j", (F.lit(float(alpha)) * F.col("x") * F.col("y") + F.col("v")).alias("v"))


def _rank_update(uplo: str, alpha: float, a: DataFrame, vectors: list[tuple[DataFrame, str, str]], term: Column) -> DataFrame:
    flag(uplo, "ul", "uplo")
    if alpha == 0:
        return a.select("i", "j", "v")
    for x, key, name in vectors:
        a = _with(a, x, key, name)
    return a.select("i", "j", F.when(in_triangle(uplo), F.lit(float(alpha)) * term + F.col("v")).otherwise(F.col("v")).alias("v"))


def syr(uplo: str, alpha: float, x: DataFrame, a: DataFrame) -> DataFrame:
    """Only the triangle changes."""
    return _rank_update(uplo, alpha, a, [(x, "i", "xi"), (x, "j", "xj")], F.col("xi") * F.col("xj"))


def syr2(uplo: str, alpha: float, x: DataFrame, y: DataFrame, a: DataFrame) -> DataFrame:
    return _rank_update(uplo, alpha, a, [(x, "i", "xi"), (y, "j", "yj"), (y, "i", "yi"), (x, "j", "xj")], F.col("xi") * F.col("yj") + F.col("yi") * F.col("xj"))


def spr(uplo: str, alpha: float, x: DataFrame, a: DataFrame) -> DataFrame:
    """On a triangle as a packed view decodes it."""
    return syr(uplo, alpha, x, a)


def spr2(uplo: str, alpha: float, x: DataFrame, y: DataFrame, a: DataFrame) -> DataFrame:
    return syr2(uplo, alpha, x, y, a)
