import numpy as np
import pytest

from tessera import blas
from tessera.operators import level3, product, solve
from tessera.sources import batch_matrix, buffer, collect_matrix, matrix
from tests.reference import flat, op, poison, random, same, sym, taken, tri

M, N, K = 6, 5, 7


@pytest.mark.parametrize("ta,tb,alpha,beta", [("n", "n", 1.5, 1.5), ("n", "t", 1.5, 0), ("t", "n", 0, 1.5), ("T", "C", 2, 0.5), ("t", "n", 1, 1), ("n", "n", 0, 0)])
def test_gemm(spark, ta, tb, alpha, beta):
    a, b, c = random(M, K), random(K, N), random(M, N)
    if beta == 0:
        c[0, 0] = np.nan
    sa, sb = op(a, ta.lower()[0] == "n" and "n" or "t"), op(b, tb.lower()[0] == "n" and "n" or "t")
    lda, ldb, ldc = 2 * sa.shape[0], sb.shape[0] + 1, 3 * M
    got = taken(blas.gemm(ta, tb, M, N, K, alpha, buffer(spark, flat(sa, lda)), lda, buffer(spark, flat(sb, ldb)), ldb, beta, buffer(spark, flat(c, ldc)), ldc), len(flat(c, ldc)))
    same(got, flat((alpha * a @ b if alpha else 0) + (beta * c if beta else np.zeros_like(c)), ldc))


def test_strategies_agree(spark):
    a, b = random(20, 33), random(33, 17)
    for strategy in ("elements", "tiles"):
        same(collect_matrix(level3.gemm("n", "n", 2, matrix(spark, a), matrix(spark, b), strategy=strategy, tile=8), 20, 17), 2 * a @ b)
    with pytest.raises(ValueError):
        level3.gemm("n", "n", 1, matrix(spark, a), matrix(spark, b), strategy="guess")
    with pytest.raises(ValueError):
        level3.gemm("n", "n", 0, matrix(spark, a), matrix(spark, b))


def stacked(x, stride):
    out = np.full(len(x) * stride, -77.0)
    for k, m in enumerate(x):
        out[k * stride : k * stride + m.size] = m.ravel(order="F")
    return out


def test_batches(spark):
    n = 4
    a, b, c = random(n, M, K), random(n, K, N), random(n, M, N)
    for alpha, beta in ((1.5, 0.5), (0, 0.5), (1.5, 0)):
        want = alpha * a @ b + beta * c
        args = (buffer(spark, stacked(a, M * K)), M, buffer(spark, stacked(b, K * N)), K, beta, buffer(spark, stacked(c, M * N)), M, n)
        same(taken(blas.gemm_batched("n", "n", M, N, K, alpha, *args), n * M * N), stacked(want, M * N))
        inter = [buffer(spark, np.transpose(x, (2, 1, 0)).ravel()) for x in (a, b, c)]
        same(taken(blas.gemm_batched("n", "n", M, N, K, alpha, inter[0], M, inter[1], K, beta, inter[2], M, n, "interleaved"), n * M * N), np.transpose(want, (2, 1, 0)).ravel())
        sb, sc = K * N + 5, 2 * M * N
        got = taken(blas.gemm_strided_batched("n", "n", M, N, K, alpha, buffer(spark, flat(a[0], M, 0)), M, 0, buffer(spark, stacked(b, sb)), K, sb, beta, buffer(spark, stacked(c, sc)), M, sc, n), n * sc)
        same(got, stacked(alpha * a[0] @ b + beta * c, sc))
        got = taken(blas.gemm_strided_batched("n", "n", M, N, K, alpha, buffer(spark, flat(a[0], M, 0)), M, 0, buffer(spark, flat(b[0], K, 0)), K, 0, beta, buffer(spark, stacked(c, sc)), M, sc, n), n * sc)
        same(got, stacked(alpha * a[0] @ b[0] + beta * c, sc))
    d = buffer(spark, np.zeros(9))
    with pytest.raises(ValueError):
        blas.gemm_strided_batched("n", "n", 3, 3, 3, 1, d, 3, 9, d, 3, 9, 0, d, 3, 8, 1)
    with pytest.raises(ValueError):
        blas.gemm_batched("n", "n", 3, 3, 3, 1, d, 3, d, 3, 0, d, 3, 1, "other")
    assert level3.gemm_batched("n", "n", 1, batch_matrix(spark, a), batch_matrix(spark, b)).count() == n * M * N


@pytest.mark.parametrize("side", "lr")
@pytest.mark.parametrize("uplo", "ul")
def test_symm(spark, side, uplo):
    k = M if side == "l" else N
    a, b, c = random(k, k), random(M, N), random(M, N)
    s = sym(a, uplo)
    got = taken(blas.symm(side, uplo, M, N, 1.5, buffer(spark, flat(poison(a, uplo), k + 2)), k + 2, buffer(spark, flat(b, M)), M, 0.5, buffer(spark, flat(c, 2 * M)), 2 * M), len(flat(c, 2 * M)))
    same(got, flat(1.5 * (s @ b if side == "l" else b @ s) + 0.5 * c, 2 * M))


@pytest.mark.parametrize("side", "lr")
@pytest.mark.parametrize("uplo", "ul")
@pytest.mark.parametrize("trans", "nt")
@pytest.mark.parametrize("diag", "nu")
def test_trsm(spark, side, uplo, trans, diag):
    k = M if side == "l" else N
    a, b = random(k, k) / 4, random(M, N)
    np.fill_diagonal(a, 4.0)
    t = op(tri(a, uplo, diag), trans)
    want = np.linalg.solve(t, 1.5 * b) if side == "l" else np.linalg.solve(t.T, 1.5 * b.T).T
    got = taken(blas.trsm(side, uplo, trans, diag, M, N, 1.5, buffer(spark, flat(poison(a, uplo, diag), k + 1)), k + 1, buffer(spark, flat(b, 2 * M)), 2 * M), len(flat(b, 2 * M)))
    same(got, flat(want, 2 * M))


def test_trsm_many_columns_in_blocks(spark):
    n, cols = 37, 150
    a, b = random(n, n) / 8, random(n, cols)
    np.fill_diagonal(a, 5.0)
    for block in (64, 10):
        same(collect_matrix(level3.trsm("l", "u", "n", "n", n, cols, 1, matrix(spark, a), matrix(spark, b), block), n, cols), np.linalg.solve(np.triu(a), b))
    with pytest.raises(ValueError):
        blas.trsm("l", "u", "n", "n", 0, 3, 1, matrix(spark, a), 3, matrix(spark, b), 3)
    with pytest.raises(ValueError):
        level3.trsm("x", "u", "n", "n", 3, 3, 1, matrix(spark, a), matrix(spark, b))


@pytest.mark.parametrize("side,uplo,trans,diag,cols", [("l", "l", "n", "n", 3), ("l", "u", "n", "u", 70), ("r", "l", "t", "n", 1)])
def test_bands_are_solved_without_steps(spark, monkeypatch, side, uplo, trans, diag, cols):
    """Many blocks that read few unknowns of others, one of them a far one, take a few rounds, not a step each."""
    n = 300
    a, i, j = random(n, n) / 8, *np.indices((n, n))
    a[(abs(i - j) > 2) & ((i != 299) | (j != 7)) & ((i != 7) | (j != 299))] = 0
    np.fill_diagonal(a, 5.0)
    b = random(n, cols) if side == "l" else random(cols, n)
    t = op(tri(a, uplo, diag), trans)
    want = np.linalg.solve(t, b) if side == "l" else np.linalg.solve(t.T, b.T).T
    monkeypatch.setattr(solve, "_stepwise", None)
    x = level3.trsm(side, uplo, trans, diag, *b.shape, 1, matrix(spark, a).where("v <> 0"), matrix(spark, b), 16)
    rows = x.collect()
    assert len(rows) == b.size
    same([r.v for r in sorted(rows)], want.ravel())


@pytest.mark.parametrize("side", "lr")
@pytest.mark.parametrize("uplo", "ul")
@pytest.mark.parametrize("trans", "nt")
@pytest.mark.parametrize("diag", "nu")
def test_trsm_of_one_table(spark, side, uplo, trans, diag):
    """A and B share their lineage."""
    a = random(M, M) / 8
    np.fill_diagonal(a, 4.0)
    table = matrix(spark, a)
    t = op(tri(a, uplo, diag), trans)
    want = np.linalg.solve(t, a) if side == "l" else np.linalg.solve(t.T, a.T).T
    for block in (1024, 4):
        same(collect_matrix(level3.trsm(side, uplo, trans, diag, M, M, 1, table, table, block), M, M), want)


def test_trsm_by_zero_reads_nothing(spark):
    a, b = np.full((3, 3), np.nan), np.full((3, 2), np.inf)
    same(collect_matrix(level3.trsm("l", "u", "n", "n", 3, 2, 0, matrix(spark, a), matrix(spark, b)), 3, 2), np.zeros((3, 2)))
    assert (collect_matrix(level3.trsm("l", "u", "n", "n", 3, 2, 0, matrix(spark, a), matrix(spark, b)), 3, 2) == 0).all()


@pytest.mark.parametrize("m,n,k", [(90, 70, 1), (3, 5, 260), (41, 3, 9), (1, 1, 1)])
def test_grid_of_tiles(spark, m, n, k):
    a, b = random(m, k), random(k, n)
    for size in (None, (m, n, k)):
        same(collect_matrix(level3.gemm("n", "n", 1, matrix(spark, a), matrix(spark, b), strategy="tiles", tile=8, size=size), m, n), a @ b)


@pytest.mark.parametrize("m,n,k", [(90, 70, 1), (65, 30, 17), (1, 40, 9)])
def test_shallow_products_never_shuffle_the_result(spark, monkeypatch, m, n, k):
    a, b = random(m, k), random(k, n).astype("float32").astype(float)
    for least, panel in ((1, 1 << 20), (1000, 200)):
        monkeypatch.setattr(product, "CELLS", 6, raising=False)
        monkeypatch.setattr(product, "LEAST", least, raising=False)
        monkeypatch.setattr(product, "PANEL", panel, raising=False)
        c = level3.gemm("n", "n", 1, matrix(spark, a), matrix(spark, b), strategy="tiles", tile=8)
        plan = c._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("MapInArrow")[0]
        rows = c.collect()
        assert len(rows) == len({(r.i, r.j) for r in rows}) == m * n
        same([r.v for r in sorted(rows)], (a @ b).ravel())


def test_shallow_products_of_matrices_with_holes(spark):
    """Tiles without their zeros, and some that are missing, give the same sums."""
    a, b = (np.where(random(*s) < 0, random(*s), 0) for s in ((50, 30), (30, 40)))
    a[8:24], a[:, 8:16], b[:, 8:17] = 0, 0, 0
    c = level3.gemm("n", "n", 1, matrix(spark, a).where("v <> 0"), matrix(spark, b).where("v <> 0"), strategy="tiles", tile=8)
    same(collect_matrix(c, 50, 40), a @ b)
    none = matrix(spark, a).where("i < 0")
    assert level3.gemm("n", "n", 1, none, none, strategy="tiles", tile=8).count() == 0


def test_offsets(spark):
    a, b, c = random(M, K), random(K, N), random(M, N)
    at = lambda x, off: np.concatenate((np.full(off, -5.0), flat(x, len(x))))
    got = taken(blas.gemm("n", "n", M, N, K, 1.5, buffer(spark, at(a, 3)), M, buffer(spark, at(b, 4)), K, 0.5, buffer(spark, at(c, 2)), M, offa=3, offb=4, offc=2), len(at(c, 2)))
    same(got, at(1.5 * a @ b + 0.5 * c, 2))
    t, y = np.triu(random(M, M)) + 9 * np.eye(M), random(M, N)
    same(taken(blas.trsm("l", "u", "n", "n", M, N, 1, buffer(spark, at(t, 3)), M, buffer(spark, at(y, 2)), M, offa=3, offb=2), len(at(y, 2))), at(np.linalg.solve(t, y), 2))
    same(taken(blas.omatcopy("t", M, K, 2, buffer(spark, at(a, 1)), M, buffer(spark, at(np.zeros((K, M)), 6)), K, offa=1, offb=6), len(at(a.T, 6))), at(2 * a.T, 6))


def test_complex(spark):
    a, b = random(3, 4) + 1j * random(3, 4), random(3, 5) + 1j * random(3, 5)
    c = random(4, 5) + 1j * random(4, 5)
    to = lambda x: spark.createDataFrame([(i, j, (float(v.real), float(v.imag))) for (i, j), v in np.ndenumerate(x)], "i long, j long, v struct<re double, im double>")
    for t, left in (("t", a.T), ("c", a.conj().T)):
        got = np.zeros((4, 5), complex)
        for r in level3.gemm_complex(t, "n", 2 - 1j, to(a), to(b), 0.5j, to(c)).collect():
            got[r.i, r.j] = complex(r.v.re, r.v.im)
        same(got, (2 - 1j) * left @ b + 0.5j * c)


def test_gram(spark):
    x = random(50, 6)
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "e array<double>").repartition(3)
    same(collect_matrix(level3.gram(df, "e"), 6, 6), x.T @ x)
