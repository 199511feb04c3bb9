"""Views: reading vectors and matrices out of flat buffers, and writing them back.

A buffer is (pos, v).  The one place where increments, leading dimensions, strides, bands and packed triangles are decoded.
Writing back leaves every element outside the view as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import flag, nonnegative, positive


def _div(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long") if by != 1 else x.cast("long")


def _read(buf: DataFrame, view) -> DataFrame:
    return buf.where(view.inside()).select(*view.keys(), F.col("v").cast("double").alias("v"))


@dataclass(frozen=True)
class VectorView:
    """n elements, ``inc`` apart, from ``off``; a negative increment walks back from the far end."""

    n: int
    inc: int = 1
    off: int = 0

    def __post_init__(self):
        nonnegative(n=self.n, off=self.off)
        if self.inc == 0:
            raise ValueError("inc must not be 0")

    def inside(self) -> Column:
        step, k = abs(self.inc), F.col("pos") - self.off
        return (k >= 0) & (k <= (self.n - 1) * step) & (F.pmod(k, F.lit(step)) == 0) if self.n else F.lit(False)

    def keys(self) -> list[Column]:
        at = _div(F.col("pos") - self.off, abs(self.inc))
        return [(at if self.inc > 0 else F.lit(self.n - 1) - at).cast("long").alias("i")]

    def read(self, buf: DataFrame) -> DataFrame:
        return _read(buf, self)

    def place(self) -> Column:
        i = F.col("i") if self.inc > 0 else F.lit(self.n - 1) - F.col("i")
        return (i * abs(self.inc) + self.off).cast("long")


@dataclass(frozen=True)
class MatrixView:
    """Column-major m x n with leading dimension ``ld``, inner increment ``inc`` and, for batches, ``stride``."""

    m: int
    n: int
    ld: int
    inc: int = 1
    off: int = 0
    stride: int = 0
    batch: int = 0

    def __post_init__(self):
        nonnegative(m=self.m, n=self.n, off=self.off)
        positive(ld=self.ld, inc=self.inc)
        if self.m and self.ld < self.inc * (self.m - 1) + 1:
            raise ValueError(f"ld must be {self.inc * (self.m - 1) + 1} at least, not {self.ld}")
        if self.batch and self.stride < self.ld * (self.n - 1) + self.inc * (self.m - 1) + 1:
            raise ValueError("stride is shorter than a matrix")

    def _split(self) -> tuple[list[Column], Column, Column, Column]:
        """Batch, if any, the column, the row, and what the inner increment leaves over."""
        k, b = F.col("pos") - self.off, []
        if self.batch:
            b, k = [_div(k, self.stride)], F.pmod(k, F.lit(self.stride))
        rest = F.pmod(k, F.lit(self.ld))
        return b, _div(k, self.ld), _div(rest, self.inc), F.pmod(rest, F.lit(self.inc))

    def inside(self) -> Column:
        b, j, i, over = self._split()
        within = (F.col("pos") >= self.off) & (j < self.n) & (i < self.m) & (over == 0)
        return within & (b[0] < self.batch) if b else within

    def keys(self) -> list[Column]:
        b, j, i, _ = self._split()
        return [*(x.alias("b") for x in b), i.alias("i"), j.alias("j")]

    def read(self, buf: DataFrame) -> DataFrame:
        return _read(buf, self)

    def place(self) -> Column:
        at = F.col("i") * self.inc + F.col("j") * self.ld + self.off
        return ((at + F.col("b") * self.stride) if self.batch else at).cast("long")


@dataclass(frozen=True)
class InterleavedView:
    """A batch whose index moves fastest: element (i, j) of matrix b at (j * ld + i) * batch + b."""

    m: int
    n: int
    ld: int
    batch: int
    off: int = 0

    def _split(self) -> tuple[Column, Column, Column]:
        k = F.col("pos") - self.off
        rest = _div(k, self.batch)
        return F.pmod(k, F.lit(self.batch)).cast("long"), F.pmod(rest, F.lit(self.ld)).cast("long"), _div(rest, self.ld)

    def inside(self) -> Column:
        _, i, j = self._split()
        return (F.col("pos") >= self.off) & (i < self.m) & (j < self.n)

    def keys(self) -> list[Column]:
        return [x.alias(n) for x, n in zip(self._split(), "bij", strict=True)]

    def read(self, buf: DataFrame) -> DataFrame:
        return _read(buf, self)

    def place(self) -> Column:
        return ((F.col("j") * self.ld + F.col("i")) * self.batch + F.col("b") + self.off).cast("long")


@dataclass(frozen=True)
class BandView:
    """Band storage: element (i, j) in row ku + i - j of column j; only the band is read."""

    m: int
    n: int
    kl: int
    ku: int
    ld: int
    off: int = 0

    def __post_init__(self):
        nonnegative(m=self.m, n=self.n, kl=self.kl, ku=self.ku, off=self.off)
        if self.ld < self.kl + self.ku + 1:
            raise ValueError("ld is shorter than the band")

    def _split(self) -> tuple[Column, Column, Column]:
        k = F.col("pos") - self.off
        j, r = _div(k, self.ld), F.pmod(k, F.lit(self.ld))
        return (r + j - self.ku).cast("long"), j, r

    def inside(self) -> Column:
        i, j, r = self._split()
        return (F.col("pos") >= self.off) & (r <= self.kl + self.ku) & (j < self.n) & (i >= 0) & (i < self.m)

    def keys(self) -> list[Column]:
        i, j, _ = self._split()
        return [i.alias("i"), j.alias("j")]

    def read(self, buf: DataFrame) -> DataFrame:
        return _read(buf, self)

    def place(self) -> Column:
        return (F.col("i") - F.col("j") + self.ku + F.col("j") * self.ld + self.off).cast("long")


def triangular_band(n: int, k: int, uplo: str, ld: int, off: int = 0) -> BandView:
    """Of a symmetric or triangular matrix one triangle's band: k + 1 rows."""
    if k >= n:
        raise ValueError("k must be less than n")
    return BandView(n, n, 0, k, ld, off) if flag(uplo, "ul", "uplo") == "u" else BandView(n, n, k, 0, ld, off)


@dataclass(frozen=True)
class PackedView:
    """A triangle, column after column, without the other one."""

    n: int
    uplo: str
    off: int = 0

    def __post_init__(self):
        nonnegative(n=self.n, off=self.off)
        flag(self.uplo, "ul", "uplo")
        if self.n > 1 << 26:
            raise ValueError("n must be 2**26 at most")

    def read(self, buf: DataFrame) -> DataFrame:
        """The column is the floor of a square root.  Up to n = 2**26 its argument is exact and no rounding crosses a whole number."""
        n, k = self.n, F.col("pos") - self.off
        count, upper = n * (n + 1) // 2, self.uplo.lower() == "u"
        half = lambda x: F.shiftright(x, 1)
        c, at = F.col("c"), F.col("at")
        # a select for each step, so that no expression is repeated within another
        rows = buf.where((k >= 0) & (k < count)).select((k if upper else F.lit(count - 1) - k).cast("long").alias("at"), F.col("v").cast("double").alias("v"))
        rows = rows.select("at", F.floor((F.sqrt(at * 8.0 + 1) - 1) / 2).cast("long").alias("c"), "v")
        r = at - half(c * (c + 1))
        i, j = (r, c) if upper else (F.lit(n - 1) - r, F.lit(n - 1) - c)
        return rows.select(i.cast("long").alias("i"), j.cast("long").alias("j"), "v")

    def place(self) -> Column:
        i, j = F.col("i"), F.col("j")
        at = _div(j * (j + 1), 2) + i if self.uplo.lower() == "u" else j * self.n - _div(j * (j + 1), 2) + i
        return (at + self.off).cast("long")


def write_back(buf: DataFrame, view, result: DataFrame) -> DataFrame:
    """The buffer with the view's elements replaced; a result outside of the buffer is lost, as memory it hasn't got."""
    new = result.select(view.place().alias("pos"), F.col("v").alias("new"), F.lit(True).alias("has"))
    return buf.join(new, "pos", "left").select("pos", F.when(F.col("has"), F.col("new")).otherwise(F.col("v")).alias("v"))


def project(buf: DataFrame, view, new: Column) -> DataFrame:
    """The buffer with ``new``, of ``v``, in the view's places: a projection."""
    return buf.select("pos", F.when(view.inside(), new).otherwise(F.col("v").cast("double")).alias("v"))


def merge(buf: DataFrame, view, result: DataFrame, new: Callable[[Column, Column], Column], missing: bool = True) -> DataFrame:
    """The buffer with ``new(old, result)`` in the view's places, by one join of buffer and result (keys and p).

    Where the result has no row, its p is null, or (``missing`` false) the place stays as it was.  Equal elements of the buffer aren't
    shuffled twice, as they are where a view is read, changed and written back.
    """
    inside, at = view.inside(), view.keys()
    keys = ["b", "i", "j"][3 - len(at) :] if len(at) > 1 else ["i"]
    # places outside of the view get negative keys, which meet nothing and, unlike nulls, spread over all partitions
    placed = buf.select("pos", F.col("v").cast("double").alias("v"), inside.alias("in"), *[F.when(inside, x).otherwise(-1 - F.col("pos")) for x in at])
    placed = placed.toDF("pos", "v", "in", *keys)
    joined = placed.join(result.select(*keys, "p", F.lit(True).alias("has")), keys, "left")
    changed = F.col("in") if missing else F.col("in") & F.col("has")
    return joined.select("pos", F.when(changed, new(F.col("v"), F.col("p"))).otherwise(F.col("v")).alias("v"))


# --- structure of matrices (i, j, v) ---


def transpose(a: DataFrame) -> DataFrame:
    return a.select(*[c for c in a.columns if c == "b"], F.col("j").alias("i"), F.col("i").alias("j"), "v")


def in_triangle(uplo: str) -> Column:
    return F.col("i") <= F.col("j") if flag(uplo, "ul", "uplo") == "u" else F.col("i") >= F.col("j")


def triangle(a: DataFrame, uplo: str, diag: str = "n") -> DataFrame:
    """The other triangle is cut off before any arithmetic, so nothing it holds can leak; a unit diagonal isn't read."""
    rows = a.where(in_triangle(uplo))
    if flag(diag, "nu", "diag") == "n":
        return rows
    return rows.withColumn("v", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("v")))


def mirror(a: DataFrame, uplo: str) -> DataFrame:
    """The symmetric matrix of which one triangle is read, in one pass over it."""
    rows = a.where(in_triangle(uplo))
    twice = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    keep = [c for c in a.columns if c == "b"]
    return rows.select(*keep, F.explode(twice).alias("ij"), "v").select(*keep, "ij.i", "ij.j", "v")


def band(a: DataFrame, kl: int, ku: int) -> DataFrame:
    d = F.col("i") - F.col("j")
    return a.where((d <= kl) & (d >= -ku))
