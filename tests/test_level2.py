import numpy as np
import pytest

from tessera import blas
from tessera.operators import level2, solve
from tessera.sources import buffer, collect_vector, matrix, vector
from tests.reference import band_of, banded, flat, op, packed, place, poison, random, same, strided, sym, taken, tri

M, N = 7, 9


def vec(spark, x, inc):
    return buffer(spark, strided(x, inc)), len(strided(x, inc))


def updated(y, inc, new):
    out = strided(y, inc)
    out[place(len(y), inc)] = new
    return out


@pytest.mark.parametrize("trans,alpha,beta,incx,incy", [("n", 1.5, 1.5, 2, 3), ("t", 1.5, 0, -2, 1), ("C", 0.0, 1.5, 1, -3), ("N", 1.5, 0, 1, 1)])
def test_gemv_and_gbmv(spark, trans, alpha, beta, incx, incy):
    a = random(M, N)
    t = trans.lower()
    x, y = random(N if t == "n" else M), random(M if t == "n" else N)
    if beta == 0:
        y[0] = np.nan  # never read
    dx, dy = vec(spark, x, incx)[0], vec(spark, y, incy)[0]
    size = len(strided(y, incy))
    old = beta * y if beta else 0
    same(taken(blas.gemv(trans, M, N, alpha, buffer(spark, flat(a, 2 * M)), 2 * M, dx, incx, beta, dy, incy), size), updated(y, incy, alpha * op(a, t) @ x + old))
    kl, ku = 3, 2
    b = buffer(spark, banded(a, kl, ku, 8))
    same(taken(blas.gbmv(trans, M, N, kl, ku, alpha, b, 8, dx, incx, beta, dy, incy), size), updated(y, incy, alpha * op(band_of(a, kl, ku), t) @ x + old))


@pytest.mark.parametrize("uplo,beta", [("u", 1.5), ("L", 0)])
def test_symmetric_products(spark, uplo, beta):
    u, a, x, y = uplo.lower(), random(N, N), random(N), random(N)
    if beta == 0:
        y[0] = np.nan
    dx, dy, size = vec(spark, x, -2)[0], vec(spark, y, 3)[0], len(strided(y, 3))
    old = beta * y if beta else 0
    same(taken(blas.symv(uplo, N, 1.5, buffer(spark, flat(poison(a, u), 12)), 12, dx, -2, beta, dy, 3), size), updated(y, 3, 1.5 * sym(a, u) @ x + old))
    k = 3
    kl, ku = (0, k) if u == "u" else (k, 0)
    same(taken(blas.sbmv(uplo, N, k, 1.5, buffer(spark, banded(a, kl, ku, 5)), 5, dx, -2, beta, dy, 3), size), updated(y, 3, 1.5 * band_of(sym(a, u), k, k) @ x + old))
    same(taken(blas.spmv(uplo, N, 1.5, buffer(spark, packed(a, u)), dx, -2, beta, dy, 3), size), updated(y, 3, 1.5 * sym(a, u) @ x + old))


@pytest.mark.parametrize("uplo", "ul")
@pytest.mark.parametrize("trans", "nt")
@pytest.mark.parametrize("diag", "nu")
def test_triangular(spark, uplo, trans, diag):
    a = random(N, N) / 4
    np.fill_diagonal(a, 5.0)
    x, inc, k = random(N), 2, 3
    dx, size = vec(spark, x, inc)
    t = op(tri(a, uplo, diag), trans)
    full = buffer(spark, flat(poison(a, uplo, diag), 11))
    same(taken(blas.trmv(uplo, trans, diag, N, full, 11, dx, inc), size), updated(x, inc, t @ x))
    same(taken(blas.trsv(uplo, trans, diag, N, full, 11, dx, inc), size), updated(x, inc, np.linalg.solve(t, x)))
    kl, ku = (0, k) if uplo == "u" else (k, 0)
    tb, b = op(band_of(tri(a, uplo, diag), k, k), trans), buffer(spark, banded(a, kl, ku, 6))
    same(taken(blas.tbmv(uplo, trans, diag, N, k, b, 6, dx, inc), size), updated(x, inc, tb @ x))
    same(taken(blas.tbsv(uplo, trans, diag, N, k, b, 6, dx, inc), size), updated(x, inc, np.linalg.solve(tb, x)))
    p = buffer(spark, packed(poison(a, uplo, diag) if diag == "u" else a, uplo))
    same(taken(blas.tpmv(uplo, trans, diag, N, p, dx, inc), size), updated(x, inc, t @ x))
    same(taken(blas.tpsv(uplo, trans, diag, N, p, dx, inc), size), updated(x, inc, np.linalg.solve(t, x)))


@pytest.mark.parametrize("uplo", "ul")
@pytest.mark.parametrize("trans", "nt")
@pytest.mark.parametrize("diag", "nu")
def test_solves_of_one_table(spark, uplo, trans, diag):
    """A and b share their lineage."""
    a = random(N, N) / 8
    np.fill_diagonal(a, 5.0)
    table = matrix(spark, a)
    b, t, k = table.where("j = 2").select("i", "v"), op(tri(a, uplo, diag), trans), 3
    tb = op(band_of(tri(a, uplo, diag), k, k), trans)
    for block in (1024, 4):
        for got, want in ((level2.trsv(uplo, trans, diag, N, table, b, block), t), (level2.tpsv(uplo, trans, diag, N, table, b, block), t), (level2.tbsv(uplo, trans, diag, N, k, table, b, block), tb)):
            same(collect_vector(got, N), np.linalg.solve(want, a[:, 2]))


def test_rows_out_of_the_band_are_scaled(spark):
    m, n = 9, 3
    a, x, y = random(m, n), random(n), random(m)
    for beta in (0, 0.5):
        got = taken(blas.gbmv("n", m, n, 1, 1, 1.5, buffer(spark, banded(a, 1, 1, 3)), 3, buffer(spark, x), 1, beta, buffer(spark, y), 1), m)
        same(got, 1.5 * band_of(a, 1, 1) @ x + beta * y)


def test_rank_updates(spark):
    a, x, y = random(M, N), random(M), random(N)
    got = taken(blas.ger(M, N, 1.5, buffer(spark, strided(x, 2)), 2, buffer(spark, strided(y, -3)), -3, buffer(spark, flat(a, 10)), 10), len(flat(a, 10)))
    same(got, flat(a + 1.5 * np.outer(x, y), 10))
    for uplo in "ul":
        a, x, y = random(N, N), random(N), random(N)
        keep = (np.triu if uplo == "u" else np.tril)(np.ones((N, N)))
        dx, dy = buffer(spark, strided(x, -2)), buffer(spark, strided(y, 3))
        d = buffer(spark, flat(a, 11))
        same(taken(blas.syr(uplo, N, 1.5, dx, -2, d, 11), len(flat(a, 11))), flat(a + 1.5 * keep * np.outer(x, x), 11))
        both = np.outer(x, y) + np.outer(y, x)
        same(taken(blas.syr2(uplo, N, 1.5, dx, -2, dy, 3, d, 11), len(flat(a, 11))), flat(a + 1.5 * keep * both, 11))
        p = buffer(spark, packed(a, uplo))
        same(taken(blas.spr(uplo, N, 1.5, dx, -2, p), N * (N + 1) // 2), packed(a + 1.5 * np.outer(x, x), uplo))
        same(taken(blas.spr2(uplo, N, 1.5, dx, -2, dy, 3, p), N * (N + 1) // 2), packed(a + 1.5 * both, uplo))
        assert blas.spr(uplo, N, 0, dx, -2, p) is p


def test_blocked_solve_and_zero_divisors(spark):
    n = 23
    a, x = random(n, n) / 8, random(n)
    np.fill_diagonal(a, 4.0)
    for uplo in "ul":
        got = {r.i: r.v for r in level2.trsv(uplo, "t", "n", n, matrix(spark, a), vector(spark, x), block=5).collect()}
        same([got[i] for i in range(n)], np.linalg.solve(tri(a, uplo, "n").T, x))
    got = {r.i: r.v for r in level2.trsv("l", "n", "n", 2, matrix(spark, [[0.0, 0], [1, 1]]), vector(spark, [1.0, 1])).collect()}
    assert got[0] == float("inf")
    assert level2.trsv("l", "n", "n", 0, matrix(spark, np.zeros((0, 0))), vector(spark, [])).collect() == []


@pytest.mark.parametrize("uplo,trans", [("l", "t"), ("u", "t")])
def test_bands_are_solved_without_steps(spark, monkeypatch, uplo, trans):
    n = 150
    a = random(n, n) / 8
    np.fill_diagonal(a, 5.0)
    a, x = band_of(a, 3, 2), random(n)
    monkeypatch.setattr(solve, "_stepwise", None)
    got = level2.trsv(uplo, trans, "n", n, matrix(spark, a).where("v <> 0"), vector(spark, x), block=16).collect()
    assert len(got) == n
    same([r.v for r in sorted(got)], np.linalg.solve(tri(a, uplo, "n").T, x))


def test_errors(spark):
    d = buffer(spark, np.zeros(100))
    for call in (
        lambda: blas.gemv("x", 3, 3, 1, d, 3, d, 1, 0, d, 1),
        lambda: blas.gemv("n", 3, 3, 1, d, 2, d, 1, 0, d, 1),
        lambda: blas.gemv("n", 3, 3, 1, d, 3, d, 0, 0, d, 1),
        lambda: blas.gbmv("n", 3, 3, 3, 1, 1, d, 5, d, 1, 0, d, 1),
        lambda: blas.gbmv("n", 3, 3, 1, 3, 1, d, 5, d, 1, 0, d, 1),
        lambda: blas.sbmv("u", 3, 3, 1, d, 4, d, 1, 0, d, 1),
        lambda: blas.tbmv("u", "n", "n", 3, 3, d, 4, d, 1),
        lambda: blas.tbsv("u", "n", "n", 3, 3, d, 4, d, 1),
        lambda: blas.symv("x", 3, 1, d, 3, d, 1, 0, d, 1),
        lambda: blas.trmv("u", "n", "x", 3, d, 3, d, 1),
        lambda: blas.spr("u", 0, 1, d, 1, d),
        lambda: blas.spr2("u", -1, 1, d, 1, d, 1, d),
    ):
        with pytest.raises(ValueError):
            call()
