"""The routines over flat buffers: sizes, increments, leading dimensions, strides and offsets as callers of BLAS give them.

Each function reads views of its buffers, applies an operator, and returns the changed buffer (or buffers) whole, elements outside
the view as they were.  Reductions return a one-row DataFrame with column v; ``value`` takes the number out.  Where a buffer starts
inside of a larger one, ``offx``, ``offy``, ``offa``, ``offb`` and ``offc`` say at which element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import extension, level1, level2, level3
from tessera.operators.level1 import value
from tessera.plans.views import BandView, InterleavedView, MatrixView, PackedView, VectorView, merge, project, triangular_band, write_back
from tessera.schema import flag, nonnegative, positive, transposed

__all__ = [
    "asum", "axpy", "axpy_batch", "copy", "dot", "gbmv", "gemm", "gemm_batched", "gemm_strided_batched", "gemv", "ger", "iamax", "iamin", "imatcopy_batch",
    "nrm2", "omatadd", "omatadd_batch", "omatcopy", "omatcopy2", "omatcopy_batch", "reduction", "rot", "rotm", "sbmv", "scal", "sdsdot", "spmv", "spr", "spr2",
    "swap", "symm", "symv", "syr", "syr2", "tbmv", "tbsv", "tpmv", "tpsv", "transpose", "trmv", "trsm", "trsv", "value",
]


def _one(df: DataFrame, column: str) -> DataFrame:
    return df.select("i", F.col(column).alias("v"))


# --- level 1 ---


def axpy(n: int, alpha: float, x: DataFrame, incx: int, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0) -> DataFrame:
    px = VectorView(n, incx, offx).read(x).withColumnRenamed("v", "p")
    return merge(y, VectorView(n, incy, offy), px, lambda old, p: F.lit(float(alpha)) * p + old, missing=False)


def copy(n: int, x: DataFrame, incx: int, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0) -> DataFrame:
    return write_back(y, VectorView(n, incy, offy), VectorView(n, incx, offx).read(x))


def swap(n: int, x: DataFrame, incx: int, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0) -> tuple[DataFrame, DataFrame]:
    vx, vy = VectorView(n, incx, offx), VectorView(n, incy, offy)
    return write_back(x, vx, vy.read(y)), write_back(y, vy, vx.read(x))


def scal(n: int, alpha: float, x: DataFrame, incx: int, *, offx: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return project(x, vx, F.lit(0.0) if alpha == 0 else F.lit(float(alpha)) * F.col("v"))


def rot(n: int, x: DataFrame, incx: int, y: DataFrame, incy: int, c: float, s: float, *, offx: int = 0, offy: int = 0) -> tuple[DataFrame, DataFrame]:
    vx, vy = VectorView(n, incx, offx), VectorView(n, incy, offy)
    out = level1.rot(vx.read(x), vy.read(y), c, s)
    return write_back(x, vx, _one(out, "x")), write_back(y, vy, _one(out, "y"))


def rotm(n: int, x: DataFrame, incx: int, y: DataFrame, incy: int, param: list[float], *, offx: int = 0, offy: int = 0) -> tuple[DataFrame, DataFrame]:
    vx, vy = VectorView(n, incx, offx), VectorView(n, incy, offy)
    out = level1.rotm(vx.read(x), vy.read(y), param)
    return write_back(x, vx, _one(out, "x")), write_back(y, vy, _one(out, "y"))


def dot(n: int, x: DataFrame, incx: int, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0) -> DataFrame:
    return level1.dot(VectorView(n, incx, offx).read(x), VectorView(n, incy, offy).read(y))


def sdsdot(n: int, sb: float, x: DataFrame, incx: int, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0) -> DataFrame:
    return level1.sdsdot(sb, VectorView(n, incx, offx).read(x), VectorView(n, incy, offy).read(y))


def asum(n: int, x: DataFrame, incx: int, *, offx: int = 0) -> DataFrame:
    return level1.asum(VectorView(n, incx, offx).read(x))


def nrm2(n: int, x: DataFrame, incx: int, *, offx: int = 0) -> DataFrame:
    return level1.nrm2(VectorView(n, incx, offx).read(x))


def _index(n: int, x: DataFrame, incx: int, offx: int, op) -> DataFrame:
    if n <= 0 or incx <= 0:  # by definition 0
        return x.sparkSession.range(1).select(F.lit(0).cast("long").alias("v"))
    return op(VectorView(n, incx, offx).read(x))


def iamax(n: int, x: DataFrame, incx: int, *, offx: int = 0) -> DataFrame:
    return _index(n, x, incx, offx, level1.iamax)


def iamin(n: int, x: DataFrame, incx: int, *, offx: int = 0) -> DataFrame:
    return _index(n, x, incx, offx, level1.iamin)


# --- level 2 ---


def _updated(buf: DataFrame, view, product: DataFrame, beta: float) -> DataFrame:
    """product (keys, v) + beta * what the view holds, which isn't read where beta is 0; a place without a product gets beta's part alone."""
    old_part = (lambda old: F.lit(0.0)) if beta == 0 else (lambda old: F.lit(float(beta)) * old)
    return merge(buf, view, product.withColumnRenamed("v", "p"), lambda old, p: F.coalesce(p, F.lit(0.0)) + old_part(old))


def gemv(trans: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, x: DataFrame, incx: int, beta: float, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    lx, ly = (m, n) if transposed(trans) else (n, m)
    vy = VectorView(ly, incy, offy)
    return _updated(y, vy, level2.gemv(trans, alpha, MatrixView(m, n, lda, off=offa).read(a), VectorView(lx, incx, offx).read(x)), beta)


def gbmv(trans: str, m: int, n: int, kl: int, ku: int, alpha: float, a: DataFrame, lda: int, x: DataFrame, incx: int, beta: float, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    lx, ly = (m, n) if transposed(trans) else (n, m)
    vy = VectorView(ly, incy, offy)
    return _updated(y, vy, level2.gbmv(trans, m, n, kl, ku, alpha, BandView(m, n, kl, ku, lda, offa).read(a), VectorView(lx, incx, offx).read(x)), beta)


def symv(uplo: str, n: int, alpha: float, a: DataFrame, lda: int, x: DataFrame, incx: int, beta: float, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    vy = VectorView(n, incy, offy)
    return _updated(y, vy, level2.symv(uplo, alpha, MatrixView(n, n, lda, off=offa).read(a), VectorView(n, incx, offx).read(x)), beta)


def sbmv(uplo: str, n: int, k: int, alpha: float, a: DataFrame, lda: int, x: DataFrame, incx: int, beta: float, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    vy = VectorView(n, incy, offy)
    return _updated(y, vy, level2.sbmv(uplo, n, k, alpha, triangular_band(n, k, uplo, lda, offa).read(a), VectorView(n, incx, offx).read(x)), beta)


def spmv(uplo: str, n: int, alpha: float, a: DataFrame, x: DataFrame, incx: int, beta: float, y: DataFrame, incy: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    vy = VectorView(n, incy, offy)
    return _updated(y, vy, level2.spmv(uplo, alpha, PackedView(n, uplo, offa).read(a), VectorView(n, incx, offx).read(x)), beta)


def trmv(uplo: str, trans: str, diag: str, n: int, a: DataFrame, lda: int, x: DataFrame, incx: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return write_back(x, vx, level2.trmv(uplo, trans, diag, MatrixView(n, n, lda, off=offa).read(a), vx.read(x)))


def tbmv(uplo: str, trans: str, diag: str, n: int, k: int, a: DataFrame, lda: int, x: DataFrame, incx: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return write_back(x, vx, level2.tbmv(uplo, trans, diag, n, k, triangular_band(n, k, uplo, lda, offa).read(a), vx.read(x)))


def tpmv(uplo: str, trans: str, diag: str, n: int, a: DataFrame, x: DataFrame, incx: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return write_back(x, vx, level2.tpmv(uplo, trans, diag, PackedView(n, uplo, offa).read(a), vx.read(x)))


def trsv(uplo: str, trans: str, diag: str, n: int, a: DataFrame, lda: int, x: DataFrame, incx: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return write_back(x, vx, level2.trsv(uplo, trans, diag, n, MatrixView(n, n, lda, off=offa).read(a), vx.read(x)))


def tbsv(uplo: str, trans: str, diag: str, n: int, k: int, a: DataFrame, lda: int, x: DataFrame, incx: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return write_back(x, vx, level2.tbsv(uplo, trans, diag, n, k, triangular_band(n, k, uplo, lda, offa).read(a), vx.read(x)))


def tpsv(uplo: str, trans: str, diag: str, n: int, a: DataFrame, x: DataFrame, incx: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    vx = VectorView(n, incx, offx)
    return write_back(x, vx, level2.tpsv(uplo, trans, diag, n, PackedView(n, uplo, offa).read(a), vx.read(x)))


def ger(m: int, n: int, alpha: float, x: DataFrame, incx: int, y: DataFrame, incy: int, a: DataFrame, lda: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    va = MatrixView(m, n, lda, off=offa)
    return write_back(a, va, level2.ger(alpha, VectorView(m, incx, offx).read(x), VectorView(n, incy, offy).read(y), va.read(a)))


def syr(uplo: str, n: int, alpha: float, x: DataFrame, incx: int, a: DataFrame, lda: int, *, offx: int = 0, offa: int = 0) -> DataFrame:
    va = MatrixView(n, n, lda, off=offa)
    return write_back(a, va, level2.syr(uplo, alpha, VectorView(n, incx, offx).read(x), va.read(a)))


def syr2(uplo: str, n: int, alpha: float, x: DataFrame, incx: int, y: DataFrame, incy: int, a: DataFrame, lda: int, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    va = MatrixView(n, n, lda, off=offa)
    return write_back(a, va, level2.syr2(uplo, alpha, VectorView(n, incx, offx).read(x), VectorView(n, incy, offy).read(y), va.read(a)))


def spr(uplo: str, n: int, alpha: float, x: DataFrame, incx: int, a: DataFrame, *, offx: int = 0, offa: int = 0) -> DataFrame:
    positive(n=n)
    va = PackedView(n, uplo, offa)
    return a if alpha == 0 else write_back(a, va, level2.spr(uplo, alpha, VectorView(n, incx, offx).read(x), va.read(a)))


def spr2(uplo: str, n: int, alpha: float, x: DataFrame, incx: int, y: DataFrame, incy: int, a: DataFrame, *, offx: int = 0, offy: int = 0, offa: int = 0) -> DataFrame:
    positive(n=n)
    va = PackedView(n, uplo, offa)
    return a if alpha == 0 else write_back(a, va, level2.spr2(uplo, alpha, VectorView(n, incx, offx).read(x), VectorView(n, incy, offy).read(y), va.read(a)))


# --- level 3 ---


def _operands(transa: str, transb: str, m: int, n: int, k: int) -> tuple[tuple[int, int], tuple[int, int]]:
    nonnegative(m=m, n=n, k=k)
    return ((k, m) if transposed(transa) else (m, k)), ((n, k) if transposed(transb) else (k, n))


def gemm(transa: str, transb: str, m: int, n: int, k: int, alpha: float, a: DataFrame, lda: int, b: DataFrame, ldb: int, beta: float, c: DataFrame, ldc: int, *, offa: int = 0, offb: int = 0, offc: int = 0) -> DataFrame:
    vc = MatrixView(m, n, ldc, off=offc)
    if alpha == 0:
        return project(c, vc, F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("v"))
    sa, sb = _operands(transa, transb, m, n, k)
    return _updated(c, vc, level3.gemm(transa, transb, alpha, MatrixView(*sa, lda, off=offa).read(a), MatrixView(*sb, ldb, off=offb).read(b), size=(m, n, k)), beta)


def gemm_batched(transa: str, transb: str, m: int, n: int, k: int, alpha: float, a: DataFrame, lda: int, b: DataFrame, ldb: int, beta: float, c: DataFrame, ldc: int, batch: int, batch_type: str = "strided", *, offa: int = 0, offb: int = 0, offc: int = 0) -> DataFrame:
    if batch_type not in ("strided", "interleaved"):
        raise ValueError(f"unknown batch type {batch_type!r}")
    sa, sb = _operands(transa, transb, m, n, k)
    if batch_type == "interleaved":
        va, vb, vc = (InterleavedView(*s, ld, batch, off) for s, ld, off in ((sa, lda, offa), (sb, ldb, offb), ((m, n), ldc, offc)))
        if alpha == 0:
            return project(c, vc, F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("v"))
        return _updated(c, vc, level3.gemm_batched(transa, transb, alpha, va.read(a), vb.read(b)), beta)
    return gemm_strided_batched(transa, transb, m, n, k, alpha, a, lda, lda * sa[1], b, ldb, ldb * sb[1], beta, c, ldc, ldc * n, batch, offa=offa, offb=offb, offc=offc)


def gemm_strided_batched(transa: str, transb: str, m: int, n: int, k: int, alpha: float, a: DataFrame, lda: int, stride_a: int, b: DataFrame, ldb: int, stride_b: int, beta: float, c: DataFrame, ldc: int, stride_c: int, batch: int, *, offa: int = 0, offb: int = 0, offc: int = 0) -> DataFrame:
    """Stride 0: one matrix for the whole batch."""
    if stride_c < ldc * n:
        raise ValueError("stride_c must be ldc * n at least")
    sa, sb = _operands(transa, transb, m, n, k)
    vc = MatrixView(m, n, ldc, off=offc, stride=stride_c, batch=batch)
    va = MatrixView(*sa, lda, off=offa, stride=stride_a, batch=batch) if stride_a else MatrixView(*sa, lda, off=offa)
    vb = MatrixView(*sb, ldb, off=offb, stride=stride_b, batch=batch) if stride_b else MatrixView(*sb, ldb, off=offb)
    if alpha == 0:
        return project(c, vc, F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("v"))
    left, right = va.read(a), vb.read(b)
    if not stride_a and not stride_b:  # every matrix gets the same product
        p = level3.gemm(transa, transb, alpha, left, right, size=(m, n, k)).withColumnRenamed("v", "p")
        old = vc.read(c)
        new = old.join(p, ["i", "j"]).select("b", "i", "j", (F.col("p") if beta == 0 else F.col("p") + F.lit(float(beta)) * F.col("v")).alias("v"))
        return write_back(c, vc, new)
    return _updated(c, vc, level3.gemm_strided_batched(transa, transb, alpha, left, right), beta)


def symm(side: str, uplo: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, b: DataFrame, ldb: int, beta: float, c: DataFrame, ldc: int, *, offa: int = 0, offb: int = 0, offc: int = 0) -> DataFrame:
    k = m if flag(side, "lr", "side") == "l" else n
    vc = MatrixView(m, n, ldc, off=offc)
    if alpha == 0:
        return project(c, vc, F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("v"))
    return _updated(c, vc, level3.symm(side, uplo, alpha, MatrixView(k, k, lda, off=offa).read(a), MatrixView(m, n, ldb, off=offb).read(b), size=(m, n, k)), beta)


def trsm(side: str, uplo: str, trans: str, diag: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, b: DataFrame, ldb: int, *, offa: int = 0, offb: int = 0) -> DataFrame:
    positive(m=m, n=n, lda=lda, ldb=ldb)
    k = m if flag(side, "lr", "side") == "l" else n
    vb = MatrixView(m, n, ldb, off=offb)
    return write_back(b, vb, level3.trsm(side, uplo, trans, diag, m, n, alpha, MatrixView(k, k, lda, off=offa).read(a), vb.read(b)))


# --- extensions ---


def axpy_batch(n: int, alpha: float, x: DataFrame, incx: int, stride_x: int, y: DataFrame, incy: int, stride_y: int, batch: int, *, offx: int = 0, offy: int = 0) -> DataFrame:
    """Increments of opposite signs reverse one operand against the other."""
    if stride_y < (n - 1) * abs(incy) + 1:
        raise ValueError("stride_y is shorter than a vector")

    def read(buf: DataFrame, inc: int, stride: int, off: int) -> DataFrame:
        view = MatrixView(n, 1, n * abs(inc), inc=abs(inc), off=off, stride=stride, batch=batch if stride else 0)
        rows = view.read(buf)
        return rows.withColumn("i", F.col("i") if inc > 0 else F.lit(n - 1) - F.col("i")).drop("j")

    new = extension.axpy_batch(alpha, read(x, incx, stride_x, offx), read(y, incy, stride_y, offy))
    place = MatrixView(n, 1, n * abs(incy), inc=abs(incy), off=offy, stride=stride_y, batch=batch)
    return write_back(y, place, new.select("b", (F.col("i") if incy > 0 else F.lit(n - 1) - F.col("i")).alias("i"), F.lit(0).alias("j"), "v"))


def _turned(trans: str, m: int, n: int) -> tuple[int, int]:
    return (n, m) if transposed(trans) else (m, n)


def omatcopy(trans: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, b: DataFrame, ldb: int, *, offa: int = 0, offb: int = 0) -> DataFrame:
    return omatcopy2(trans, m, n, alpha, a, lda, 1, b, ldb, 1, offa=offa, offb=offb)


def omatcopy2(trans: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, inca: int, b: DataFrame, ldb: int, incb: int, *, offa: int = 0, offb: int = 0) -> DataFrame:
    vb = MatrixView(*_turned(trans, m, n), ldb, incb, offb)
    return write_back(b, vb, extension.omatcopy(trans, alpha, MatrixView(m, n, lda, inca, offa).read(a)))


def omatadd(transa: str, transb: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, beta: float, b: DataFrame, ldb: int, c: DataFrame, ldc: int, *, offa: int = 0, offb: int = 0, offc: int = 0) -> DataFrame:
    vc = MatrixView(m, n, ldc, off=offc)
    left, right = MatrixView(*_turned(transa, m, n), lda, off=offa).read(a), MatrixView(*_turned(transb, m, n), ldb, off=offb).read(b)
    return write_back(c, vc, extension.omatadd(transa, transb, alpha, left, beta, right))


def omatcopy_batch(trans: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, stride_a: int, b: DataFrame, ldb: int, stride_b: int, batch: int, *, offa: int = 0, offb: int = 0) -> DataFrame:
    vb = MatrixView(*_turned(trans, m, n), ldb, off=offb, stride=stride_b, batch=batch)
    return write_back(b, vb, extension.omatcopy_batch(trans, alpha, MatrixView(m, n, lda, off=offa, stride=stride_a, batch=batch).read(a)))


def imatcopy_batch(trans: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, ldb: int, stride: int, batch: int, *, offa: int = 0) -> DataFrame:
    """Input and output share the buffer; where their layouts differ, what the output doesn't cover stays."""
    return omatcopy_batch(trans, m, n, alpha, a, lda, stride, a, ldb, stride, batch, offa=offa, offb=offa)


def omatadd_batch(transa: str, transb: str, m: int, n: int, alpha: float, a: DataFrame, lda: int, stride_a: int, beta: float, b: DataFrame, ldb: int, stride_b: int, c: DataFrame, ldc: int, stride_c: int, batch: int, *, offa: int = 0, offb: int = 0, offc: int = 0) -> DataFrame:
    vc = MatrixView(m, n, ldc, off=offc, stride=stride_c, batch=batch)
    left = MatrixView(*_turned(transa, m, n), lda, off=offa, stride=stride_a, batch=batch).read(a)
    right = MatrixView(*_turned(transb, m, n), ldb, off=offb, stride=stride_b, batch=batch).read(b)
    return write_back(c, vc, extension.omatadd_batch(transa, transb, alpha, left, beta, right))


def transpose(m: int, n: int, a: DataFrame, lda: int, b: DataFrame, ldb: int, *, offa: int = 0, offb: int = 0) -> DataFrame:
    return omatcopy("t", m, n, 1.0, a, lda, b, ldb, offa=offa, offb=offb)


def reduction(op: str, a: DataFrame, lda: int, out: DataFrame, rows: int, cols: int, dimension: str, *, offa: int = 0, offout: int = 0) -> DataFrame:
    n = cols if dimension == "inner" else rows
    return write_back(out, VectorView(n, 1, offout), extension.reduction(op, dimension, MatrixView(rows, cols, lda, off=offa).read(a)))
