import math

import numpy as np
import pytest

from tessera import blas
from tessera.functions import givens
from tessera.operators import level1
from tessera.plans.views import VectorView
from tessera.sources import buffer, collect_vector, fill, vector
from tests.reference import place, random, same, strided, taken

N = 11


@pytest.mark.parametrize("incx,incy,alpha", [(1, 1, 1.5), (4, 3, 0), (-1, 1, 1), (-3, -2, 1.5), (4, -2, 1.5)])
def test_two_vectors(spark, incx, incy, alpha):
    x, y = random(N), random(N)
    bx, by = strided(x, incx), strided(y, incy)
    dx, dy = buffer(spark, bx), buffer(spark, by)

    def wrote(b, inc, v):
        out = b.copy()
        out[place(N, inc)] = v
        return out

    same(taken(blas.axpy(N, alpha, dx, incx, dy, incy), len(by)), wrote(by, incy, alpha * x + y))
    same(taken(blas.copy(N, dx, incx, dy, incy), len(by)), wrote(by, incy, x))
    sx, sy = blas.swap(N, dx, incx, dy, incy)
    same(taken(sx, len(bx)), wrote(bx, incx, y))
    same(taken(sy, len(by)), wrote(by, incy, x))
    rx, ry = blas.rot(N, dx, incx, dy, incy, 0.8, 0.6)
    same(taken(rx, len(bx)), wrote(bx, incx, 0.8 * x + 0.6 * y))
    same(taken(ry, len(by)), wrote(by, incy, -0.6 * x + 0.8 * y))
    assert math.isclose(blas.value(blas.dot(N, dx, incx, dy, incy)), x @ y)
    want = np.float32(9.5 + x.astype(np.float32).astype(float) @ y.astype(np.float32).astype(float))
    assert blas.value(blas.sdsdot(N, 9.5, dx, incx, dy, incy)) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("flag,h", [(-2, np.eye(2)), (-1, [[1.5, 0.5], [-0.5, 2]]), (0, [[1, 0.5], [-0.5, 1]]), (1, [[1.5, 1], [-1, 2]]), (-4, [[1.5, 0.5], [-0.5, 2]])])
def test_rotm(spark, flag, h):
    x, y = random(N), random(N)
    dx, dy = blas.rotm(N, buffer(spark, x), 1, buffer(spark, strided(y, -2)), -2, [flag, 1.5, -0.5, 0.5, 2])
    want = np.array(h) @ np.stack([x, y])
    same(taken(dx, N), want[0])
    same(taken(dy, 2 * N + 2)[place(N, -2)], want[1])


@pytest.mark.parametrize("inc", [1, 4, -3])
def test_one_vector(spark, inc):
    x = random(N)
    b = strided(x, inc)
    d = buffer(spark, b)
    assert math.isclose(blas.value(blas.asum(N, d, inc)), abs(x).sum())
    assert math.isclose(blas.value(blas.nrm2(N, d, inc)), np.linalg.norm(x))
    for alpha in (0, 1.5):
        got = taken(blas.scal(N, alpha, d, inc), len(b))
        want = b.copy()
        want[place(N, inc)] = alpha * x
        same(got, want)
    assert blas.value(blas.iamax(N, d, inc)) == (int(abs(x).argmax()) if inc > 0 else 0)
    assert blas.value(blas.iamin(N, d, inc)) == (int(abs(x).argmin()) if inc > 0 else 0)


def test_special_elements(spark):
    nan, inf = float("nan"), float("inf")
    x = vector(spark, [nan, 3.0, -3.0, 1.0, -1.0, nan])
    assert blas.value(level1.iamax(x)) == 1 and blas.value(level1.iamin(x)) == 3  # NaN is passed over, ties go to the first
    same(collect_vector(level1.scal(0, vector(spark, [nan, inf, 1.0])), 3), [0, 0, 0])
    same(collect_vector(level1.axpy(0, vector(spark, [nan, 1.0]), vector(spark, [1.0, 2.0])), 2), [nan, 2])
    empty = vector(spark, [])
    assert [blas.value(f(empty)) for f in (level1.asum, level1.nrm2, level1.iamax, level1.iamin)] == [0, 0, 0, 0]
    assert blas.value(level1.dot(empty, empty)) == 0 and blas.value(level1.sdsdot(0.5, empty, empty)) == 0.5
    assert blas.value(blas.dot(0, buffer(spark, [1.0]), 1, buffer(spark, [1.0]), 1)) == 0
    assert taken(fill(spark, 4, 2.5), 4).tolist() == [2.5] * 4


def test_views_check_their_arguments():
    for bad in ({"n": -1}, {"n": 3, "inc": 0}, {"n": 3, "off": -1}):
        with pytest.raises(ValueError):
            VectorView(**bad)


@pytest.mark.parametrize("a,b", [(3, 4), (-3, 4), (4, -3), (0, 0), (0, 5), (-2, 0), (1, -1), (1e-3, 7)])
def test_rotg(spark, a, b):
    r = level1.rotg(spark.createDataFrame([(float(a), float(b))], "a double, b double")).first()
    same([r.c * a + r.s * b, -r.s * a + r.c * b, r.c**2 + r.s**2], [r.r, 0, 1], 1e-9)
    c, s = (0.0, 1.0) if r.z == 1 else (math.sqrt(1 - r.z**2), r.z) if abs(r.z) < 1 else (1 / r.z, math.sqrt(1 - 1 / r.z**2))
    same([abs(c), abs(s)], [abs(r.c), abs(r.s)], 1e-6)


def test_rotmg_zeroes_the_second_element(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, 10 ** rng.uniform(-12, 12, 2))) + tuple(map(float, rng.uniform(-5, 5, 2))) for _ in range(200)]
    for (d1, d2, x1, y1), r in zip(rows, level1.rotmg(spark.createDataFrame(rows, "d1 double, d2 double, x1 double, y1 double").coalesce(1)).select("rotmg.*").collect(), strict=True):
        assert tuple(r) == givens.rotmg_values(d1, d2, x1, y1)
        h11, h12, h21, h22 = givens.rotm_matrix([r.flag, r.h11, r.h21, r.h12, r.h22])
        assert h11 * x1 + h12 * y1 == pytest.approx(r.x1, rel=1e-9)
        assert abs(h21 * x1 + h22 * y1) <= 1e-9 * (abs(h21 * x1) + abs(h22 * y1))
        assert r.d1 * r.x1**2 == pytest.approx(d1 * x1**2 + d2 * y1**2, rel=1e-9)  # the weighted length stays
        assert all(d == 0 or givens.GAMMA**-2 <= abs(d) <= givens.GAMMA**2 for d in (r.d1, r.d2))


def test_rotmg_special_cases():
    assert givens.rotmg_values(-1, 1, 1, 1) == (0, 0, 0, -1, 0, 0, 0, 0)
    assert givens.rotmg_values(1, 2, 3, 0) == (1, 2, 3, -2, 1, 0, 0, 1)
    assert givens.rotmg_values(0, 2, 3, 4) == (2, 0, 4, 1, 0, -1, 1, 0)
    assert givens.rotmg_values(1, -2, 1, 5)[3] == -1 and givens.rotmg_values(1, -2, 1, 5)[:3] == (0, 0, 0)


def test_complex_scal(spark):
    x = spark.createDataFrame([(0, (1.0, 2.0)), (1, (float("nan"), 1.0))], "i long, v struct<re double, im double>")
    got = {r.i: complex(r.v.re, r.v.im) for r in level1.scal_complex(2 - 1j, x).collect()}
    assert got[0] == (2 - 1j) * (1 + 2j)
    assert all(r.v.re == r.v.im == 0 for r in level1.scal_complex(0, x).collect())
