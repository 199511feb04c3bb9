import numpy as np
import pytest

from tessera import blas
from tessera.operators import extension
from tessera.plans import expr
from tessera.sources import buffer, matrix, matrix_of_rows, vector
from tests.reference import flat, op, place, random, same, taken

M, N, B = 6, 4, 3


def test_copies(spark):
    a = random(M, N)
    for trans, alpha in (("n", 1.5), ("t", 1), ("T", 0)):
        m, n = (M, N) if trans == "n" else (N, M)
        out = flat(random(m, n), 2 * m)
        got = taken(blas.omatcopy(trans, M, N, alpha, buffer(spark, flat(a, 8)), 8, buffer(spark, out), 2 * m), len(out))
        want = out.copy()
        for j in range(n):
            want[j * 2 * m : j * 2 * m + m] = alpha * op(a, trans.lower())[:, j]
        same(got, want)
    src, dst = np.full(3 * M * N, -77.0), np.full(4 * M * N, -7.0)
    for (i, j), v in np.ndenumerate(a):
        src[i * 2 + j * 3 * M] = v
    got = taken(blas.omatcopy2("t", M, N, 2, buffer(spark, src), 3 * M, 2, buffer(spark, dst), 4 * N, 3), len(dst))
    for (i, j), v in np.ndenumerate(a):
        dst[j * 3 + i * 4 * N] = 2 * v
    same(got, dst)
    same(taken(blas.transpose(M, N, buffer(spark, flat(a, M, 0)), M, buffer(spark, np.zeros(M * N)), N), M * N), a.ravel())


def test_sums(spark):
    for ta in "nt":
        for tb in "nt":
            a, b, c = op(random(M, N), ta), op(random(M, N), tb), flat(random(M, N), 9)
            got = taken(blas.omatadd(ta, tb, M, N, 1.5, buffer(spark, flat(a, 7)), 7, 0.5, buffer(spark, flat(b, 8)), 8, buffer(spark, c), 9), len(c))
            for j in range(N):
                c[j * 9 : j * 9 + M] = (1.5 * op(a, ta) + 0.5 * op(b, tb))[:, j]
            same(got, c)


def stack(x, ld, stride):
    out = np.full(len(x) * stride, -77.0)
    for k, m in enumerate(x):
        f = flat(m, ld, 0)
        out[k * stride : k * stride + len(f)] = f
    return out


def test_batched_copies(spark):
    a, b = random(B, M, N), random(B, N, M)
    sa, sb = stack(a, 8, 40), stack(b, 5, 50)
    at = stack(np.transpose(1.5 * a, (0, 2, 1)), 5, 50)
    same(taken(blas.omatcopy_batch("t", M, N, 1.5, buffer(spark, sa), 8, 40, buffer(spark, sb), 5, 50, B), len(sb)), at)
    same(taken(blas.imatcopy_batch("n", M, N, 1.5, buffer(spark, sa), 8, 8, 40, B), len(sa)), stack(1.5 * a, 8, 40))
    c = stack(random(B, M, N), 6, 30)
    got = taken(blas.omatadd_batch("n", "t", M, N, 1.5, buffer(spark, sa), 8, 40, 0.5, buffer(spark, sb), 5, 50, buffer(spark, c), 6, 30, B), len(c))
    same(got, stack(1.5 * a + 0.5 * np.transpose(b, (0, 2, 1)), 6, 30))


@pytest.mark.parametrize("incx,incy,mul", [(1, 1, 1), (-1, 3, 1), (2, -5, 2), (-4, -3, 1), (1, 1, 0), (-2, 1, 0)])
def test_axpy_batch(spark, incx, incy, mul):
    n = 5
    sx, sy = mul * n * abs(incx), n * abs(incy)
    x, y = random(max(1, B if mul else 1) * max(sx, n * abs(incx))), random(B * sy)
    got = taken(blas.axpy_batch(n, 1.5, buffer(spark, x), incx, sx, buffer(spark, y), incy, sy, B), len(y))
    for k in range(B):
        y[k * sy + place(n, incy)] += 1.5 * x[k * sx + place(n, incx)]
    same(got, y)


def test_reductions(spark):
    a = random(7, 5) - 1
    ops = {"add": np.sum, "absadd": lambda x, axis: abs(x).sum(axis=axis), "product": np.prod, "min": np.min, "max": np.max, "mean": np.mean}
    d = buffer(spark, flat(a, 10))
    for name, f in ops.items():
        same(taken(blas.reduction(name, d, 10, buffer(spark, np.zeros(5)), 7, 5, "inner"), 5), f(a, axis=0))
        same(taken(blas.reduction(name, d, 10, buffer(spark, np.zeros(7)), 7, 5, "outer"), 7), f(a, axis=1))
    for bad in (("sum", "inner"), ("add", "both")):
        with pytest.raises(ValueError):
            extension.reduction(*bad, matrix(spark, a))


def test_errors(spark):
    d = buffer(spark, np.zeros(100))
    for call in (
        lambda: blas.omatcopy("n", 4, 4, 1, d, 3, d, 4),
        lambda: blas.omatcopy("n", 4, 4, 1, d, 4, d, 3),
        lambda: blas.omatcopy2("n", 4, 4, 1, d, 6, 2, d, 4, 1),
        lambda: blas.omatcopy("q", 4, 4, 1, d, 4, d, 4),
        lambda: blas.omatcopy_batch("n", 4, 4, 1, d, 4, 10, d, 4, 16, 2),
        lambda: blas.omatadd("n", "n", 4, 4, 1, d, 3, 1, d, 4, d, 4),
        lambda: blas.transpose(4, 4, d, 4, d, 3),
        lambda: blas.axpy_batch(4, 1, d, 1, 4, d, 2, 5, 2),
    ):
        with pytest.raises(ValueError):
            call()


def test_expression_trees(spark):
    x, y = random(9), random(9)
    vx, vy = expr.Vector(vector(spark, x)), expr.Vector(vector(spark, y))
    tree = expr.Assign("z", expr.BinaryOp("add", expr.ScalarOp("product", 2, expr.Assign("xc", vx)), expr.Assign("yc", vy)))
    rows = sorted(expr.evaluate(tree).collect())
    same([[r.xc, r.yc, r.z] for r in rows], np.stack([x, y, 2 * x + y], axis=1))
    assert expr.reduce("absadd", expr.ScalarOp("product", -3, vx)).first().v == pytest.approx(abs(3 * x).sum())
    assert expr.reduce("iamax", expr.BinaryOp("add", vx, vy)).first().v == abs(x + y).argmax()
    nested = expr.evaluate(expr.Assign("t", expr.Collapse(expr.TupleOp(expr.TupleOp(vx)), 10))).collect()
    assert {r.t.ind: r.t.val for r in nested} == {11 * i: v for i, v in enumerate(x)}
    both = sorted(expr.evaluate(expr.DoubleAssign("a", "b", vy, vx)).collect())
    same([[r.a, r.b] for r in both], np.stack([y, x], axis=1))
    same([r.v for r in sorted(expr.evaluate(expr.UnaryOp("square", vx)).collect())], x * x)
    assert expr.evaluate(expr.Join(expr.Assign("p", vx), expr.Assign("q", vx))).columns == ["i", "p", "q"]
    with pytest.raises(ValueError):
        expr._Builder().joined()
    with pytest.raises(TypeError):
        expr.evaluate(object())


def test_fusion_and_pruning(spark, tmp_path):
    x = vector(spark, random(5))
    plan = expr.evaluate(expr.Assign("z", expr.ScalarOp("add", 1, expr.UnaryOp("square", expr.Assign("k", expr.Vector(x))))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1 and "Join" not in plan
    df = spark.createDataFrame([(0, [1.0, 2.0], "unused")], "k long, e array<double>, other string")
    df.write.parquet(f"{tmp_path}/t")
    read = matrix_of_rows(spark.read.parquet(f"{tmp_path}/t"), "k", "e")._jdf.queryExecution().executedPlan().toString()
    assert "other" not in read
