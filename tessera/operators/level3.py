"""Matrix-matrix operators on Mat (i, j, v) and Batch (b, i, j, v).

Products choose their strategy by shape (``tessera.operators.product``).  ``alpha == 0`` scales C alone, ``beta == 0`` never reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.product import batched, product
from tessera.operators.solve import solve
from tessera.plans.strategy import TILE
from tessera.plans.views import mirror, transpose
from tessera.schema import flag, positive, transposed


def gemm(transa: str, transb: str, alpha: float, a: DataFrame, b: DataFrame, beta: float = 0.0, c: DataFrame | None = None, strategy: str = "auto", tile: int = TILE, size: tuple[int, int, int] | None = None) -> DataFrame:
    """alpha op(A) op(B) + beta C.  With ``alpha == 0`` C gives the shape, and flags aren't looked at.  ``size`` is (m, n, k), where known."""
    if alpha == 0:
        if c is None:
            raise ValueError("alpha is 0: c must be given")
        keys = [*batched(c), "i", "j"]
        return c.select(*keys, (F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("v")).alias("v"))
    p = product(transpose(a) if transposed(transa) else a, transpose(b) if transposed(transb) else b, strategy, tile, size)
    keys = [x for x in p.columns if x != "p"]
    scaled = F.lit(float(alpha)) * F.col("p")
    if beta == 0 or c is None:
        return p.select(*keys, scaled.alias("v"))
    return c.join(p, keys, "left").select(*keys, (F.coalesce(scaled, F.lit(0.0)) + F.lit(float(beta)) * F.col("v")).alias("v"))


def gemm_batched(transa: str, transb: str, alpha: float, a: DataFrame, b: DataFrame, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """Every matrix of the batch; both layouts decode to the same (b, i, j, v)."""
    return gemm(transa, transb, alpha, a, b, beta, c)


def gemm_strided_batched(transa: str, transb: str, alpha: float, a: DataFrame, b: DataFrame, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """An operand of stride 0 is a plain Mat, shared by the batch."""
    if not batched(a) and not batched(b) and (c is None or not batched(c)):
        raise ValueError("no operand has a batch index")
    return gemm(transa, transb, alpha, a, b, beta, c)


def gemm_complex(transa: str, transb: str, alpha: complex, a: DataFrame, b: DataFrame, beta: complex = 0, c: DataFrame | None = None) -> DataFrame:
    """On (i, j, v struct<re, im>); 'c' conjugates."""
    al, be = complex(alpha), complex(beta)

    def side(df: DataFrame, trans: str, names: tuple[str, str], re: str, im: str) -> DataFrame:
        t = transpose(df) if transposed(trans) else df
        sign = -1.0 if trans.lower() == "c" else 1.0
        return t.select(F.col("i").alias(names[0]), F.col("j").alias(names[1]), F.col("v.re").alias(re), (F.col("v.im") * sign).alias(im))

    met = side(a, transa, ("i", "k"), "ar", "ai").join(side(b, transb, ("k", "j"), "br", "bi"), "k")
    p = met.groupBy("i", "j").agg(F.sum(F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")).alias("pr"), F.sum(F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")).alias("pi"))
    re, im = F.col("pr") * al.real - F.col("pi") * al.imag, F.col("pr") * al.imag + F.col("pi") * al.real
    if be == 0 or c is None:
        return p.select("i", "j", F.struct(re.alias("re"), im.alias("im")).alias("v"))
    cr, ci = F.col("v.re"), F.col("v.im")
    zero = F.lit(0.0)
    return c.join(p, ["i", "j"], "left").select("i", "j", F.struct((F.coalesce(re, zero) + cr * be.real - ci * be.imag).alias("re"), (F.coalesce(im, zero) + cr * be.imag + ci * be.real).alias("im")).alias("v"))


def symm(side: str, uplo: str, alpha: float, a: DataFrame, b: DataFrame, beta: float = 0.0, c: DataFrame | None = None, strategy: str = "auto", size: tuple[int, int, int] | None = None) -> DataFrame:
    s = mirror(a, uplo)
    left, right = (s, b) if flag(side, "lr", "side") == "l" else (b, s)
    return gemm("n", "n", alpha, left, right, beta, c, strategy, size=size)


def trsm(side: str, uplo: str, trans: str, diag: str, m: int, n: int, alpha: float, a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """X (m x n) of op(A) X = alpha B or X op(A) = alpha B.  With ``alpha == 0`` X is zero, and neither A nor B's elements are read."""
    positive(m=m, n=n)
    flag(side, "lr", "side"), flag(uplo, "ul", "uplo"), flag(diag, "nu", "diag"), transposed(trans)
    if alpha == 0:
        return b.select("i", "j", F.lit(0.0).alias("v"))
    scaled = b.select("i", "j", (F.lit(float(alpha)) * F.col("v")).alias("v"))
    if flag(side, "lr", "side") == "l":
        return solve(uplo, trans, diag, m, n, a, scaled, block)
    other = "n" if transposed(trans) else "t"
    return transpose(solve(uplo, other, diag, n, m, a, transpose(scaled), block))


def gram(table: DataFrame, values: str) -> DataFrame:
    """X^T X of a table of row arrays in one pass: each task adds the outer products of its rows in numpy."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts:
            column = batch.column(0)
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "p"])

    rows = table.select(values).where(F.col(values).isNotNull()).mapInArrow(add, "i long, j long, p double")
    return rows.groupBy("i", "j").agg(F.sum("p").alias("v"))
