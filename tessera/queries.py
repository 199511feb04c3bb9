"""The operators as queries over whole tables, each with its twin in SQL.

Operands come from whole tables: E is the matrix of all embeddings, G = E^T E, S = G scaled to be unsymmetric, T = S with a dominant
diagonal, U = S / 10 (for unit diagonals), X the column sums of E, Y the diagonal of G, XE a vector as long as E; O1 and O2 are vectors
over orders, P over parts, Z over customers, B the embeddings as 8 x 8 matrices; ZM has eight multiples of Z as columns, and L is a lower
band, diagonally dominant, as large as there are customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import blas
from tessera.functions.scalar import BINARY, UNARY
from tessera.operators import extension, level1, level2, level3
from tessera.plans import expr, views
from tessera.sources import collect_matrix, collect_vector, fill, matrix, matrix_of_rows, parquet_vector, to_buffer, vector

N = 64
KL, KU, K = 3, 2, 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FIXTURES = """
E AS (SELECT vec_id::BIGINT AS i, unnest(range(len(embedding)))::BIGINT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
G AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM E a JOIN E b USING (i) GROUP BY a.j, b.j),
S AS (SELECT i, j, v * (1 + i / 64.0 - j / 128.0) AS v FROM G),
T AS (SELECT i, j, CASE WHEN i = j THEN 10 * v ELSE v END AS v FROM S),
U AS (SELECT i, j, v / 10 AS v FROM S),
X AS (SELECT j AS i, sum(v) AS v FROM E GROUP BY j),
Y AS (SELECT i, v FROM G WHERE i = j),
XE AS (SELECT vec_id::BIGINT AS i, (label + 1) / 10.0 AS v FROM embeddings),
O1 AS (SELECT o_orderkey::BIGINT AS i, o_totalprice / 300007.0 AS v FROM orders),
O2 AS (SELECT o_orderkey::BIGINT AS i, o_custkey / 1000.0 AS v FROM orders),
P AS (SELECT p_partkey::BIGINT AS i, p_retailprice / 1000 AS v FROM part),
Z AS (SELECT c_custkey::BIGINT AS i, c_acctbal AS v FROM customer),
B AS (SELECT i AS b, j % 8 AS i, j // 8 AS j, v FROM E),
ZM AS (SELECT c_custkey::BIGINT AS i, c.range AS j, c_acctbal / 1003 * (c.range + 1) AS v FROM customer, range(8) c)"""


class Operands:
    """The fixtures as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vector(self, table: str, index: str, value: Column) -> DataFrame:
        return parquet_vector(self.spark, f"{self.dir}/{table}.parquet", index, value)

    def __getattr__(self, name: str) -> DataFrame:
        """Made once for a query, so that its plan holds equal parts, whose shuffles Spark runs once."""
        made = self.__dict__[name] = self._make(name)
        return made

    def _make(self, name: str) -> DataFrame:
        v, diagonal = F.col("v"), F.col("i") == F.col("j")
        if name == "E":
            return matrix_of_rows(self.table("embeddings"), "vec_id", "embedding")
        if name == "G":
            return level3.gram(self.table("embeddings"), "embedding")
        if name == "S":
            return self.G.withColumn("v", v * (1 + F.col("i") / 64.0 - F.col("j") / 128.0))
        if name == "T":
            return self.S.withColumn("v", F.when(diagonal, 10 * v).otherwise(v))
        if name == "U":
            return self.S.withColumn("v", v / 10)
        if name == "X":
            return extension.reduction("add", "inner", self.E)
        if name == "Y":
            return self.G.where(diagonal).select("i", "v")
        if name == "B":
            return self.E.select(F.col("i").alias("b"), F.pmod("j", F.lit(8)).alias("i"), F.floor(F.col("j") / 8).alias("j"), "v")
        if name == "XE":
            return self.vector("embeddings", "vec_id", (F.col("label") + 1) / 10.0)
        if name == "O1":
            return self.vector("orders", "o_orderkey", F.col("o_totalprice") / 300007.0)
        if name == "O2":
            return self.vector("orders", "o_orderkey", F.col("o_custkey") / 1000.0)
        if name == "P":
            return self.vector("part", "p_partkey", F.col("p_retailprice") / 1000)
        if name == "ZM":
            return self.table("customer").select(F.col("c_custkey").cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j"), "c_acctbal").select("i", "j", (F.col("c_acctbal") / 1003 * (F.col("j") + 1)).alias("v"))
        if name == "L":
            rows = self.table("customer").select(F.col("c_custkey").cast("long").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d"), "c_nationkey")
            element = F.when(F.col("d") == 0, 4 + F.col("c_nationkey") / 10).otherwise((F.col("c_nationkey") + 1) / (25 * (F.col("d") + 1)))
            return rows.select("i", (F.col("i") - F.col("d")).alias("j"), element.alias("v")).where("j >= 0")
        if name == "Z":
            return self.vector("customer", "c_custkey", F.col("c_acctbal"))
        raise AttributeError(name)


def add(name: str, make: Callable[[Operands], DataFrame], sql: str | None, values: str = "v", digits: int = 6) -> None:
    """Registers a query; ``values`` are rounded on both sides, as sums in another order differ in the last bits."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")
    rounded = values.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(Operands(spark, sf_dir))
        return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in rounded else F.col(c) for c in df.columns])

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE {FIXTURES}, result AS ({sql}) SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in rounded)}) FROM result" if rounded else f"WITH RECURSIVE {FIXTURES} {sql}"


# --- level 1 ---

A = 1.5
add("axpy", lambda o: level1.axpy(A, o.O1, o.O2), f"SELECT i, {A} * a.v + b.v AS v FROM O1 a JOIN O2 b USING (i)")
add("axpy_neg", lambda o: blas.axpy(n := o.table("orders").count(), A, to_buffer(o.O1, F.col("i")), -1, to_buffer(o.O2, F.col("i")), 1), f"SELECT b.i AS pos, {A} * a.v + b.v AS v FROM O2 b JOIN O1 a ON a.i = (SELECT count(*) FROM orders) - 1 - b.i")
add("axpy_inc", lambda o: blas.axpy((o.table("orders").count() + 1) // 2, A, to_buffer(o.O1, F.col("i") * 3), 3, to_buffer(o.O2, F.col("i")), -2), f"""SELECT b.i AS pos, CASE WHEN b.i % 2 = 0 THEN b.v + {A} * a.v ELSE b.v END AS v
    FROM O2 b LEFT JOIN O1 a ON b.i % 2 = 0 AND a.i = ((SELECT count(*) FROM orders) + 1) // 2 - 1 - b.i // 2""")
add("copy", lambda o: level1.copy(o.O1), "SELECT i, v FROM O1")
add("dot", lambda o: level1.dot(o.O1, o.O2), "SELECT sum(a.v * b.v) AS v FROM O1 a JOIN O2 b USING (i)")
add("sdsdot", lambda o: level1.sdsdot(9.5, o.P, o.P).select(F.col("v").cast("double").alias("v")), "SELECT (9.5 + sum(v::FLOAT::DOUBLE * v::FLOAT::DOUBLE))::FLOAT::DOUBLE AS v FROM P", digits=3)
add("asum", lambda o: level1.asum(o.Z), "SELECT sum(abs(v)) AS v FROM Z", digits=3)
add("nrm2", lambda o: level1.nrm2(o.Z), "SELECT sqrt(sum(v * v)) AS v FROM Z", digits=4)
add("iamax", lambda o: level1.iamax(o.Z), "SELECT i AS v FROM Z ORDER BY abs(Z.v) DESC, i LIMIT 1", values="")
add("iamin", lambda o: level1.iamin(o.Z), "SELECT i AS v FROM Z ORDER BY abs(Z.v), i LIMIT 1", values="")
add("iamax_tie", lambda o: level1.iamax(o.Z.withColumn("v", F.round(F.col("v") / 1000))), "SELECT i AS v FROM Z ORDER BY abs(round(Z.v / 1000)) DESC, i LIMIT 1", values="")
add("iamin_tie", lambda o: level1.iamin(o.Z.withColumn("v", F.round(F.col("v") / 1000))), "SELECT i AS v FROM Z ORDER BY abs(round(Z.v / 1000)), i LIMIT 1", values="")
add("swap", lambda o: level1.swap(o.O1, o.O2), "SELECT i, b.v AS x, a.v AS y FROM O1 a JOIN O2 b USING (i)", values="x y")
add("scal", lambda o: level1.scal(A, o.O1), f"SELECT i, {A} * v AS v FROM O1")
add("scal_a0", lambda o: level1.scal(0, o.O1), "SELECT i, 0.0::DOUBLE AS v FROM O1")
add("scal_matrix", lambda o: level1.scal_matrix(A, o.E), f"SELECT i, j, {A} * v AS v FROM E")
add("scal_complex", lambda o: level1.scal_complex(1.5 - 2j, o.O1.join(o.O2.withColumnRenamed("v", "w"), "i").select("i", F.struct(F.col("v").alias("re"), F.col("w").alias("im")).alias("v"))).select("i", F.col("v.re").alias("re"), F.col("v.im").alias("im")),
    "SELECT i, 1.5 * a.v + 2 * b.v AS re, 1.5 * b.v - 2 * a.v AS im FROM O1 a JOIN O2 b USING (i)", values="re im")
add("rot", lambda o: level1.rot(o.O1, o.O2, 0.8, 0.6), "SELECT i, 0.8 * a.v + 0.6 * b.v AS x, -0.6 * a.v + 0.8 * b.v AS y FROM O1 a JOIN O2 b USING (i)", values="x y")
for _name, _flag, _h in (("m1", -1, (1.5, 0.5, -0.5, 2)), ("0", 0, (1, 0.5, -0.5, 1)), ("1", 1, (1.5, 1, -1, 2)), ("m2", -2, (1, 0, 0, 1)), ("other", -4, (1.5, 0.5, -0.5, 2))):
    add(f"rotm_{_name}", lambda o, f=_flag: level1.rotm(o.O1, o.O2, [f, 1.5, -0.5, 0.5, 2]), f"SELECT i, {_h[0]} * a.v + {_h[1]} * b.v AS x, {_h[2]} * a.v + {_h[3]} * b.v AS y FROM O1 a JOIN O2 b USING (i)", values="x y")

add("rotg", lambda o: level1.rotg(o.table("customer").select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_nationkey") - 12.0).alias("b"))),
    """SELECT i, a, b, r, CASE WHEN abs(a) >= abs(b) THEN s WHEN c <> 0 THEN 1 / c ELSE 1 END AS z, c, s FROM (SELECT *, CASE WHEN r = 0 THEN 1 ELSE a / r END AS c, CASE WHEN r = 0 THEN 0 ELSE b / r END AS s FROM
    (SELECT *, (CASE WHEN abs(a) > abs(b) THEN sign(a) ELSE sign(b) END) * sqrt(a * a + b * b) AS r FROM (SELECT c_custkey AS i, c_acctbal / 1000 AS a, c_nationkey - 12.0::DOUBLE AS b FROM customer)))""", values="a b r z c s")  # fmt: skip


def _rotmg(o: Operands) -> DataFrame:
    rows = o.table("customer").select(F.col("c_custkey").alias("i"), (1 + F.col("c_nationkey") / 10.0).alias("a"), F.lit(2.0).alias("b"), (1 + F.abs("c_acctbal") / 5003).alias("x"), (F.col("c_nationkey") / 5.0 - 2).alias("y"))
    return level1.rotmg(rows, "a", "b", "x", "y").select("i", *[F.col(f"rotmg.{c}").alias(c) for c in ("d1", "d2", "x1", "flag", "h11", "h21", "h12", "h22")])


# these weights need no rescaling, whose repetition SQL can't follow; tests cover it
add("rotmg", _rotmg, """
    SELECT i, CASE WHEN unit THEN a WHEN big THEN a / (1 + b * y * y / (a * x * x)) ELSE b / (1 + a * x * x / (b * y * y)) END AS d1,
        CASE WHEN unit THEN b WHEN big THEN b / (1 + b * y * y / (a * x * x)) ELSE a / (1 + a * x * x / (b * y * y)) END AS d2,
        CASE WHEN unit THEN x WHEN big THEN x * (1 + b * y * y / (a * x * x)) ELSE y * (1 + a * x * x / (b * y * y)) END AS x1,
        CASE WHEN unit THEN -2.0 WHEN big THEN 0.0 ELSE 1.0 END::DOUBLE AS flag,
        CASE WHEN unit OR big THEN 1 ELSE a * x / (b * y) END AS h11, CASE WHEN unit THEN 0 WHEN big THEN -y / x ELSE -1 END AS h21,
        CASE WHEN unit THEN 0 WHEN big THEN b * y / (a * x) ELSE 1 END AS h12, CASE WHEN unit OR big THEN 1 ELSE x / y END AS h22
    FROM (SELECT *, y = 0 AS unit, abs(a * x * x) > abs(b * y * y) AS big FROM
        (SELECT c_custkey AS i, 1 + c_nationkey / 10.0::DOUBLE AS a, 2.0::DOUBLE AS b, 1 + abs(c_acctbal) / 5003 AS x, c_nationkey / 5.0::DOUBLE - 2 AS y FROM customer))""", values="d1 d2 x1 flag h11 h21 h12 h22")  # fmt: skip

# --- level 2 ---

BETA = 0.5


def _mv(matrix: str, x: str = "X", where: str = "true") -> str:
    return f"(SELECT m.i, sum(m.v * x.v) AS v FROM {matrix} m JOIN {x} x ON m.j = x.i WHERE {where} GROUP BY m.i)"


def _update(product: str, y: str = "Y") -> str:
    return f"SELECT y.i, {A} * coalesce(p.v, 0) + {BETA} * y.v AS v FROM {y} y LEFT JOIN {product} p USING (i)"


_TURNED = "(SELECT j AS i, i AS j, v FROM {})"
_TRI = {"u": "m.i <= m.j", "l": "m.i >= m.j"}
_BAND = f"m.i - m.j BETWEEN -{KU} AND {KL}"
_SYMMETRIC = {u: f"(SELECT i, j, v FROM (SELECT * FROM T m WHERE {w}) UNION ALL SELECT j, i, v FROM (SELECT * FROM T m WHERE {w}) WHERE i <> j)" for u, w in _TRI.items()}

add("gemv_n", lambda o: level2.gemv("n", A, o.E, o.X, BETA, o.XE), _update(_mv("E"), "XE"))
add("gemv_t", lambda o: level2.gemv("t", A, o.E, o.XE, BETA, o.X), _update(_mv(_TURNED.format("E"), "XE"), "X"))
add("gemv_b0", lambda o: level2.gemv("n", A, o.E, o.X), f"SELECT i, {A} * v AS v FROM {_mv('E')}")
add("gemv_ld", lambda o: blas.gemv("n", N, N, A, to_buffer(o.S, F.col("i") + F.col("j") * 2 * N), 2 * N, to_buffer(o.X, (N - 1 - F.col("i")) * 2), -2, BETA, to_buffer(o.Y, F.col("i") * 3), 3), f"SELECT i * 3 AS pos, v FROM ({_update(_mv('S'))})")
add("ger", lambda o: level2.ger(A, o.XE, o.X, o.E), f"SELECT E.i, E.j, E.v + {A} * a.v * b.v AS v FROM E JOIN XE a ON a.i = E.i JOIN X b ON b.i = E.j")
for _t in "nt":
    _m = "S" if _t == "n" else _TURNED.format("S")
    _w = _BAND if _t == "n" else f"m.j - m.i BETWEEN -{KU} AND {KL}"
    add(f"gbmv_{_t}", lambda o, t=_t: level2.gbmv(t, N, N, KL, KU, A, o.S, o.X, BETA, o.Y), _update(_mv(_m, where=_w)))
add("gbmv_buffer", lambda o: blas.gbmv("n", N, N, KL, KU, A, to_buffer(views.band(o.S, KL, KU), views.BandView(N, N, KL, KU, 8).place()), 8, to_buffer(o.X, F.col("i")), 1, BETA, to_buffer(o.Y, F.col("i")), 1), f"SELECT i AS pos, v FROM ({_update(_mv('S', where=_BAND))})")
for _u in "ul":
    add(f"symv_{_u}", lambda o, u=_u: level2.symv(u, A, o.T, o.X, BETA, o.Y), _update(_mv(_SYMMETRIC[_u])))
    add(f"sbmv_{_u}", lambda o, u=_u: level2.sbmv(u, N, K, A, o.T, o.X, BETA, o.Y), _update(_mv(_SYMMETRIC[_u], where=f"abs(m.i - m.j) <= {K}")))
    add(f"spmv_{_u}", lambda o, u=_u: blas.spmv(u, N, A, to_buffer(views.triangle(o.T, u), views.PackedView(N, u).place()), to_buffer(o.X, F.col("i")), 1, BETA, to_buffer(o.Y, F.col("i")), 1), f"SELECT i AS pos, v FROM ({_update(_mv(_SYMMETRIC[_u]))})")
    add(f"syr_{_u}", lambda o, u=_u: level2.syr(u, A, o.X, o.S), f"SELECT m.i, m.j, m.v + CASE WHEN {_TRI[_u]} THEN {A} * a.v * b.v ELSE 0 END AS v FROM S m JOIN X a ON a.i = m.i JOIN X b ON b.i = m.j")
    add(f"syr2_{_u}", lambda o, u=_u: level2.syr2(u, A, o.X, o.Y, o.S), f"SELECT m.i, m.j, m.v + CASE WHEN {_TRI[_u]} THEN {A} * (a.v * d.v + c.v * b.v) ELSE 0 END AS v FROM S m JOIN X a ON a.i = m.i JOIN X b ON b.i = m.j JOIN Y c ON c.i = m.i JOIN Y d ON d.i = m.j")
    _pos = "(j * (j + 1)) // 2 + i" if _u == "u" else f"j * {N} - (j * (j + 1)) // 2 + i"
    _packed = lambda o, u=_u: to_buffer(views.triangle(o.S, u), views.PackedView(N, u).place())
    add(f"spr_{_u}", lambda o, u=_u, p=_packed: blas.spr(u, N, A, to_buffer(o.X, F.col("i")), 1, p(o)), f"SELECT {_pos} AS pos, v FROM (SELECT m.i, m.j, m.v + {A} * a.v * b.v AS v FROM S m JOIN X a ON a.i = m.i JOIN X b ON b.i = m.j WHERE {_TRI[_u]})")
    add(f"spr2_{_u}", lambda o, u=_u, p=_packed: blas.spr2(u, N, A, to_buffer(o.X, F.col("i")), 1, to_buffer(o.Y, F.col("i")), 1, p(o)), f"SELECT {_pos} AS pos, v FROM (SELECT m.i, m.j, m.v + {A} * (a.v * d.v + c.v * b.v) AS v FROM S m JOIN X a ON a.i = m.i JOIN X b ON b.i = m.j JOIN Y c ON c.i = m.i JOIN Y d ON d.i = m.j WHERE {_TRI[_u]})")


def _triangle_sql(matrix: str, u: str, t: str, unit: bool, where: str = "true") -> str:
    """op(A) of a triangle as (i, j, v)."""
    v = "CASE WHEN m.i = m.j THEN 1.0 ELSE m.v END" if unit else "m.v"
    return f"(SELECT {'m.j AS i, m.i AS j' if t == 't' else 'm.i, m.j'}, {v} AS v FROM {matrix} m WHERE {_TRI[u]} AND {where})"


def _solve_sql(tri: str, lower: bool, rhs: str, n: int = N) -> str:
    """(i, j, v) of the solution for right-hand sides (i, j, v), by a recursive fold over the rows."""
    at = (lambda c: c) if lower else (lambda c: f"{n - 1} - {c}")
    return f"""SELECT {at('k')} AS i, j, x[k + 1] AS v FROM (
        WITH RECURSIVE tri AS MATERIALIZED {tri},
        r AS MATERIALIZED (SELECT {at('a.i')} AS i, list(coalesce(t.v, 0) ORDER BY {at('a.j')}) AS r FROM (SELECT p.range AS i, q.range AS j FROM range({n}) p, range({n}) q) a LEFT JOIN tri t ON t.i = a.i AND t.j = a.j GROUP BY a.i),
        rhs AS MATERIALIZED (SELECT {at('i')} AS i, j, v FROM {rhs}),
        f AS (SELECT 0::BIGINT AS k, j, []::DOUBLE[] AS x FROM (SELECT DISTINCT j FROM rhs) UNION ALL
              SELECT f.k + 1, f.j, list_append(f.x, (rhs.v - CASE WHEN f.k = 0 THEN 0 ELSE list_dot_product(r.r[1:f.k], f.x) END) / r.r[f.k + 1])
              FROM f JOIN r ON r.i = f.k JOIN rhs ON rhs.i = f.k AND rhs.j = f.j WHERE f.k < {n})
        SELECT j, x FROM f WHERE len(x) = {n}), (SELECT range AS k FROM range({n}))"""


for _u in "ul":
    for _t in "nt":
        for _unit in (False, True):
            _d, _m = ("u", "U") if _unit else ("n", "T")
            _end = f"{_u}{_t}" + ("_unit" if _unit else "")
            _tri, _low = _triangle_sql(_m, _u, _t, _unit), (_u == "l") == (_t == "n")
            _in_band = f"abs(m.i - m.j) <= {K}"
            _band_tri = _triangle_sql(_m, _u, _t, _unit, _in_band)
            _x = "(SELECT i, 0 AS j, v FROM X)"
            _buf = lambda o, m=_m, u=_u: to_buffer(views.triangle(getattr(o, m), u), views.PackedView(N, u).place())
            _vec = lambda o: to_buffer(o.X, F.col("i"))
            add(f"trmv_{_end}", lambda o, u=_u, t=_t, d=_d, m=_m: level2.trmv(u, t, d, getattr(o, m), o.X), f"SELECT * FROM {_mv(_tri)}")
            add(f"tbmv_{_end}", lambda o, u=_u, t=_t, d=_d, m=_m: level2.tbmv(u, t, d, N, K, getattr(o, m), o.X), f"SELECT * FROM {_mv(_band_tri)}")
            add(f"tpmv_{_end}", lambda o, u=_u, t=_t, d=_d, b=_buf, x=_vec: blas.tpmv(u, t, d, N, b(o), x(o), 1), f"SELECT i AS pos, v FROM {_mv(_tri)}")
            add(f"trsv_{_end}", lambda o, u=_u, t=_t, d=_d, m=_m: level2.trsv(u, t, d, N, getattr(o, m), o.X), f"SELECT i, v FROM ({_solve_sql(_tri, _low, _x)})")
            add(f"tbsv_{_end}", lambda o, u=_u, t=_t, d=_d, m=_m: level2.tbsv(u, t, d, N, K, getattr(o, m), o.X), f"SELECT i, v FROM ({_solve_sql(_band_tri, _low, _x)})")
            add(f"tpsv_{_end}", lambda o, u=_u, t=_t, d=_d, b=_buf, x=_vec: blas.tpsv(u, t, d, N, b(o), x(o), 1), f"SELECT i AS pos, v FROM ({_solve_sql(_tri, _low, _x)})")

# --- level 3 ---


def _mm(a: str, b: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"(SELECT {k}a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.j = b.i{' AND a.b = b.b' if keys == 'a.b' else ''} GROUP BY {k}a.i, b.j)"


def _op(m: str, t: str, keys: str = "") -> str:
    return m if t == "n" else f"(SELECT {keys}j AS i, i AS j, v FROM {m})"


def _mm_update(product: str, c: str = "G", keys: str = "i, j", b: str = "") -> str:
    return f"SELECT {b}c.i, c.j, {A} * p.v + {BETA} * c.v AS v FROM {c} c JOIN {product} p USING ({keys})"


add("gemm_nn", lambda o: level3.gemm("n", "n", A, o.E, o.S, BETA, o.E), _mm_update(_mm("E", "S"), "E"))
add("gemm_nt", lambda o: level3.gemm("n", "t", A, o.S, o.T, BETA, o.G), _mm_update(_mm("S", _op("T", "t"))), digits=3)
add("gemm_tn", lambda o: level3.gemm("t", "n", A, o.E, o.E, BETA, o.G), _mm_update(_mm(_op("E", "t"), "E")))
add("gemm_tt", lambda o: level3.gemm("t", "t", A, o.S, o.T, BETA, o.G), _mm_update(_mm(_op("S", "t"), _op("T", "t"))), digits=3)
add("gemm_tiles", lambda o: level3.gemm("t", "n", A, o.E, o.E, strategy="tiles", tile=48), f"SELECT i, j, {A} * v AS v FROM {_mm(_op('E', 't'), 'E')}")
add("gemm_b0", lambda o: level3.gemm("n", "n", A, o.E, o.S), f"SELECT i, j, {A} * v AS v FROM {_mm('E', 'S')}")
add("gemm_a0", lambda o: level3.gemm("n", "n", 0, o.E, o.S, BETA, o.E), f"SELECT i, j, {BETA} * v AS v FROM E")
# long and thin, and wide: no key may hold all elements
add("gemm_outer", lambda o: level3.gemm("n", "t", A, o.P.select("i", F.lit(0).cast("long").alias("j"), "v"), o.X.select("i", F.lit(0).cast("long").alias("j"), "v"), strategy="tiles", tile=64), f"SELECT a.i, b.i AS j, {A} * a.v * b.v AS v FROM P a, X b")
add("gemm_wide", lambda o: level3.gemm("n", "t", A, o.E, o.E, strategy="tiles", tile=48), f"SELECT a.i, b.i AS j, {A} * sum(a.v * b.v) AS v FROM E a JOIN E b USING (j) GROUP BY a.i, b.i")
add("gemm_complex", lambda o: level3.gemm_complex("c", "n", 2 - 1j, *[o.S.select("i", "j", F.struct("v", (F.col("v") / 2).alias("w")).alias("v")).select("i", "j", F.struct(F.col("v.v").alias("re"), F.col("v.w").alias("im")).alias("v"))] * 2).select("i", "j", F.col("v.re").alias("re"), F.col("v.im").alias("im")),
    "SELECT i, j, 2 * r + m AS re, 2 * m - r AS im FROM (SELECT a.j AS i, b.j, sum(1.25 * a.v * b.v) AS r, sum(0.0 * a.v * b.v) AS m FROM S a JOIN S b USING (i) GROUP BY a.j, b.j)", values="re im", digits=3)
add("gram", lambda o: o.G, "SELECT i, j, v FROM G")
add("gemm_batched", lambda o: level3.gemm_batched("n", "t", A, o.B, o.B, BETA, o.B), _mm_update(_mm("B", _op("B", "t", "b, "), "a.b"), "B", "b, i, j", "c.b, "))


def _interleaved(o: Operands) -> DataFrame:
    n = o.table("embeddings").count()
    buf = to_buffer(o.B, (F.col("j") * 8 + F.col("i")) * n + F.col("b"))
    return blas.gemm_batched("n", "n", 8, 8, 8, A, buf, 8, buf, 8, BETA, buf, 8, n, "interleaved")


add("gemm_batched_interleaved", _interleaved, f"SELECT (j * 8 + i) * (SELECT count(*) FROM embeddings) + b AS pos, v FROM ({_mm_update(_mm('B', 'B', 'a.b'), 'B', 'b, i, j', 'c.b, ')})")


def _strided(o: Operands, shared: bool) -> DataFrame:
    n = o.table("embeddings").count()
    buf, wide = to_buffer(o.B, F.col("b") * 64 + F.col("j") * 8 + F.col("i")), to_buffer(o.B, F.col("b") * 100 + F.col("j") * 10 + F.col("i"))
    first = to_buffer(o.G.where("i < 8 AND j < 8"), F.col("j") * 8 + F.col("i")) if shared else buf
    return blas.gemm_strided_batched("t", "n", 8, 8, 8, A, first, 8, 0 if shared else 64, buf, 8, 64, BETA, wide, 10, 100, n)


add("gemm_strided_batched", lambda o: _strided(o, False), f"SELECT b * 100 + j * 10 + i AS pos, v FROM ({_mm_update(_mm(_op('B', 't', 'b, '), 'B', 'a.b'), 'B', 'b, i, j', 'c.b, ')})")
add("gemm_shared_operand", lambda o: _strided(o, True), f"SELECT b * 100 + j * 10 + i AS pos, v FROM ({_mm_update(_mm('(SELECT j AS i, i AS j, v FROM G WHERE i < 8 AND j < 8)', 'B', 'b.b'), 'B', 'b, i, j', 'c.b, ')})")
for _side in ("left", "right"):
    for _u in "ul":
        _s = _SYMMETRIC[_u]
        add(f"symm_{_side}_{_u}", lambda o, s=_side[0], u=_u: level3.symm(s, u, A, o.T, o.S, BETA, o.G), _mm_update(_mm(_s, "S") if _side == "left" else _mm("S", _s)), digits=3)
        for _t in "nt":
            for _unit in (False, True):
                _d, _m = ("u", "U") if _unit else ("n", "T")
                # X op(A) = B is op(A)^T X^T = B^T
                _tt = _t if _side == "left" else "nt"[_t == "n"]
                _rhs = f"(SELECT {'i, j' if _side == 'left' else 'j AS i, i AS j'}, {A} * v AS v FROM S)"
                _sql = _solve_sql(_triangle_sql(_m, _u, _tt, _unit), (_u == "l") == (_tt == "n"), _rhs)
                add(f"trsm_{_side}_{_u}_{_t}" + ("_unit" if _unit else ""), lambda o, s=_side[0], u=_u, t=_t, d=_d, m=_m: level3.trsm(s, u, t, d, N, N, A, getattr(o, m), o.S), f"SELECT {'i, j' if _side == 'left' else 'j AS i, i AS j'}, v FROM ({_sql})", digits=5)


def _blocked(o: Operands, x: DataFrame) -> DataFrame:
    """L X = 1.5 (L X') has the solution 1.5 X'; more than 1024 customers are solved in blocks."""
    n = o.table("customer").count()
    return level3.trsm("l", "l", "n", "n", n, 8, A, o.L, level3.gemm("n", "n", 1.0, o.L, x, strategy="elements"))


add("trsm_blocked", lambda o: _blocked(o, o.ZM), f"SELECT i, j, {A} * v AS v FROM ZM", digits=5)
add("trsv_blocked", lambda o: level2.trsv("l", "t", "n", o.table("customer").count(), o.L, level2.gemv("t", 1.0, o.L, o.Z)), "SELECT i, v FROM Z", digits=5)

# --- extensions ---

add("axpy_batch", lambda o: extension.axpy_batch(A, o.E.select(F.col("i").alias("b"), F.col("j").alias("i"), "v"), o.E.select(F.col("i").alias("b"), F.col("j").alias("i"), (F.col("v") * 2).alias("v"))), f"SELECT i AS b, j AS i, {A} * v + 2 * v AS v FROM E")
add("axpy_batch_shared", lambda o: extension.axpy_batch(A, o.X, o.E.select(F.col("i").alias("b"), F.col("j").alias("i"), "v")), f"SELECT E.i AS b, E.j AS i, {A} * X.v + E.v AS v FROM E JOIN X ON X.i = E.j")
add("omatcopy_n", lambda o: extension.omatcopy("n", A, o.E), f"SELECT i, j, {A} * v AS v FROM E")
add("omatcopy_t", lambda o: extension.omatcopy("t", A, o.E), f"SELECT j AS i, i AS j, {A} * v AS v FROM E")
add("omatcopy2", lambda o: blas.omatcopy2("t", N, N, A, to_buffer(o.S, F.col("i") * 2 + F.col("j") * 3 * N), 3 * N, 2, to_buffer(o.G, F.col("i") * 3 + F.col("j") * 4 * N), 4 * N, 3), f"SELECT j * 3 + i * 4 * {N} AS pos, {A} * v AS v FROM S")
for _ta in "nt":
    for _tb in "nt":
        add(f"omatadd_{_ta}{_tb}", lambda o, ta=_ta, tb=_tb: extension.omatadd(ta, tb, A, o.S, BETA, o.T), f"SELECT a.i, a.j, {A} * a.v + {BETA} * b.v AS v FROM {_op('S', _ta)} a JOIN {_op('T', _tb)} b USING (i, j)")
add("omatcopy_batch", lambda o: extension.omatcopy_batch("t", A, o.B), f"SELECT b, j AS i, i AS j, {A} * v AS v FROM B")
add("imatcopy_batch", lambda o: extension.imatcopy_batch("n", A, o.B), f"SELECT b, i, j, {A} * v AS v FROM B")
add("omatadd_batch", lambda o: extension.omatadd_batch("n", "t", A, o.B, BETA, o.B), f"SELECT a.b, a.i, a.j, {A} * a.v + {BETA} * c.v AS v FROM B a JOIN B c ON a.b = c.b AND a.i = c.j AND a.j = c.i")
add("transpose", lambda o: extension.transpose(o.E), "SELECT j AS i, i AS j, v FROM E")
for _name, _sql in (("add", "sum(v)"), ("absadd", "sum(abs(v))"), ("product", "product(1 + v)"), ("min", "min(v)"), ("max", "max(v)"), ("mean", "avg(v)")):
    for _dim, _key in (("inner", "j"), ("outer", "i")):
        add(f"reduction_{_name}_{_dim}", lambda o, n=_name, d=_dim: extension.reduction(n, d, o.E.withColumn("v", 1 + F.col("v")) if n == "product" else o.E), f"SELECT {_key} AS i, {_sql} AS v FROM E GROUP BY {_key}")

# --- expression trees and functors ---


def _axpy_copy(o: Operands) -> DataFrame:
    x, y = o.O1, o.O2
    return expr.evaluate(expr.Assign("z", expr.BinaryOp("add", expr.ScalarOp("product", A, expr.Assign("xcopy", expr.Vector(x))), expr.Assign("ycopy", expr.Vector(y)))))


add("expr_axpy_copy", _axpy_copy, f"SELECT i, a.v AS xcopy, b.v AS ycopy, {A} * a.v + b.v AS z FROM O1 a JOIN O2 b USING (i)", values="xcopy ycopy z")
add("expr_scal_asum", lambda o: expr.reduce("absadd", expr.ScalarOp("product", A, expr.Vector(o.Z))), f"SELECT sum(abs({A} * v)) AS v FROM Z", digits=3)
add("expr_collapse_tuple", lambda o: expr.evaluate(expr.Assign("t", expr.Collapse(expr.TupleOp(expr.TupleOp(expr.Vector(o.P))), 10))).select("i", F.col("t.ind").alias("ind"), F.col("t.val").alias("val")), "SELECT i, 11 * i AS ind, v AS val FROM P", values="val")
add("expr_double_assign", lambda o: expr.evaluate(expr.DoubleAssign("x", "y", expr.Vector(b := o.O2), expr.Vector(o.O1))), "SELECT i, b.v AS x, a.v AS y FROM O1 a JOIN O2 b USING (i)", values="x y")
add("expr_join", lambda o: expr.evaluate(expr.Join(expr.Assign("s", expr.UnaryOp("square", expr.Vector(p := o.P))), expr.Assign("n", expr.UnaryOp("negation", expr.Vector(p))))), "SELECT i, v * v AS s, -v AS n FROM P", values="s n")


def _functors(o: Operands) -> DataFrame:
    a, b = F.col("c_acctbal") / 1003, F.col("c_nationkey") - 12.0
    columns = [UNARY[n](F.abs(a) if n == "sqrt" else a).alias(n) for n in UNARY] + [BINARY[n](a, b).alias(f"b_{n}") for n in BINARY if n != "mean"]
    return o.table("customer").select(F.col("c_custkey").alias("i"), *columns)


add("scalar_functors", _functors, """
    SELECT i, abs(a) AS absolute, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, a AS identity, sign(a)::DOUBLE AS sign, -a AS negation, sqrt(abs(a)) AS sqrt, a + a AS double, a * a AS square,
        a + b AS b_add, a * b AS b_product, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'inf'::DOUBLE WHEN a < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE a / b END AS b_division,
        greatest(a, b) AS b_max, least(a, b) AS b_min, abs(a) + abs(b) AS b_absolute_add, sqrt(a * a + b * b) AS b_hypotenuse
    FROM (SELECT c_custkey AS i, c_acctbal / 1003 AS a, c_nationkey - 12.0::DOUBLE AS b FROM customer)""", values="absolute zero one identity sign negation sqrt double square b_add b_product b_max b_min b_absolute_add b_hypotenuse b_division", digits=6)  # fmt: skip

# --- buffers that start inside of larger ones, and sources and sinks ---

OFF = 5


def _at(df: DataFrame, position: str | Column, off: int) -> DataFrame:
    """The elements from place ``off`` on; what stands before must stay."""
    position = F.expr(position) if isinstance(position, str) else position
    before = df.sparkSession.range(off).select(F.col("id").alias("pos"), F.lit(-7.0).alias("v"))
    return before.unionByName(to_buffer(df, position + off))


def _kept(sql: str, off: int = OFF) -> str:
    return f"SELECT pos + {off} AS pos, v FROM ({sql}) UNION ALL SELECT range, -7.0 FROM range({off})"


_I, _IJ = "i", f"i + j * {N}"
add("axpy_offset", lambda o: blas.axpy(o.table("orders").count(), A, _at(o.O1, _I, 3), 1, _at(o.O2, _I, OFF), 1, offx=3, offy=OFF), _kept(f"SELECT i AS pos, {A} * a.v + b.v AS v FROM O1 a JOIN O2 b USING (i)"))
add("gemv_offset", lambda o: blas.gemv("n", N, N, A, _at(o.S, _IJ, 2), N, _at(o.X, _I, 3), 1, BETA, _at(o.Y, _I, OFF), 1, offa=2, offx=3, offy=OFF), _kept(f"SELECT i AS pos, v FROM ({_update(_mv('S'))})"))
add("gbmv_offset", lambda o: blas.gbmv("n", N, N, KL, KU, A, _at(views.band(o.S, KL, KU), views.BandView(N, N, KL, KU, 8).place(), 2), 8, _at(o.X, _I, 3), 1, BETA, _at(o.Y, _I, OFF), 1, offa=2, offx=3, offy=OFF), _kept(f"SELECT i AS pos, v FROM ({_update(_mv('S', where=_BAND))})"))
add("spmv_offset", lambda o: blas.spmv("u", N, A, _at(views.triangle(o.T, "u"), views.PackedView(N, "u").place(), 2), _at(o.X, _I, 3), 1, BETA, _at(o.Y, _I, OFF), 1, offa=2, offx=3, offy=OFF), _kept(f"SELECT i AS pos, v FROM ({_update(_mv(_SYMMETRIC['u']))})"))
add("gemm_offset", lambda o: blas.gemm("n", "t", N, N, N, A, _at(o.S, _IJ, 2), N, _at(o.T, _IJ, 3), N, BETA, _at(o.G, _IJ, OFF), N, offa=2, offb=3, offc=OFF), _kept(f"SELECT i + j * {N} AS pos, v FROM ({_mm_update(_mm('S', _op('T', 't')))})"), digits=3)


def _offset_batch(o: Operands, interleaved: bool) -> DataFrame:
    n = o.table("embeddings").count()
    place = (F.col("j") * 8 + F.col("i")) * n + F.col("b") if interleaved else F.col("b") * 64 + F.col("j") * 8 + F.col("i")
    a, b, c = (_at(o.B, place, off) for off in (2, 3, OFF))
    return blas.gemm_batched("n", "n", 8, 8, 8, A, a, 8, b, 8, BETA, c, 8, n, "interleaved" if interleaved else "strided", offa=2, offb=3, offc=OFF)


for _kind, _place in (("interleaved", "(j * 8 + i) * (SELECT count(*) FROM embeddings) + b"), ("strided", "b * 64 + j * 8 + i")):
    add(f"gemm_{_kind}_offset", lambda o, k=_kind: _offset_batch(o, k == "interleaved"), _kept(f"SELECT {_place} AS pos, v FROM ({_mm_update(_mm('B', 'B', 'a.b'), 'B', 'b, i, j', 'c.b, ')})"))
add("fill", lambda o: fill(o.spark, o.table("part").count(), 2.5), "SELECT p_partkey::BIGINT AS pos, 2.5::DOUBLE AS v FROM part")
add("host_round_trip", lambda o: vector(o.spark, collect_vector(o.P, o.table("part").count())), "SELECT i, v FROM P")
add("host_round_trip_matrix", lambda o: matrix(o.spark, collect_matrix(o.G, N, N)), "SELECT i, j, v FROM G")
