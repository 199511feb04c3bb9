"""Triangular solves.

All forms become a lower, untransposed system: transposing swaps the indices, an upper triangle is turned round.  Up to ``block``
unknowns the triangle goes once to each group of right-hand sides, which are solved in parallel.

Beyond, the rows of blocks are looked at: where they read few unknowns of earlier blocks, as those of a band do, these unknowns are the
interface.  All blocks are solved at once for their right-hand sides and for the unknowns that they read, which gives a triangular system of
the interface alone; it is solved by the same means, and then all blocks at once from its solution.  A band of n unknowns so takes a
logarithm of n rounds.

Where blocks read too many, as those of a dense triangle do, there are steps: the triangle and the right-hand sides are written once by rows of blocks, so that a step reads its own row alone; the blocks on the diagonal are inverted in parallel
before the first step; and step s is X_s = inverse_s (B_s - sum over k < s of T_sk X_k), two products by the strategy of any product.
A part of X is written once, in a folder of its own, and never changed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.product import product
from tessera.plans.strategy import fresh_dir
from tessera.plans.views import transpose, triangle
from tessera.schema import MAT, flag, nonnegative, transposed

#: Right-hand sides that are solved together.
TOGETHER = 64
#: A block reads at most this many blocks' unknowns of earlier ones, and the interface is at most this part of all, else there are steps.
READ, PART = 4, 0.5
#: What a row of a block's group is: an element of the triangle, of a right-hand side, an unknown of the interface with its number there (of
#: the block itself, or read by it), the value of one that it reads.
TRIANGLE, RIGHT, OWN, READS, KNOWN = range(5)


def forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of x in order; a zero on the diagonal gives infinities or NaN, as division does."""
    x = np.array(b, float)
    with np.errstate(all="ignore"):
        for k in range(len(x)):
            x[k] = (x[k] - lower[k, :k] @ x[:k]) / lower[k, k]
    return x


def _whole(a: DataFrame, b: DataFrame, n: int, cols: int) -> DataFrame:
    groups = max(1, -(-cols // TOGETHER))
    # both sides may come from one table: new names keep Spark from taking the columns of one for the other's
    tri = a.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("tg"), F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("v").alias("tv"))
    rhs = b.select((F.col("j") / TOGETHER).cast("int").alias("bg"), F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv"))

    def solve(right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"i": [], "j": [], "v": []}).astype({"i": "int64", "j": "int64", "v": "float64"})
        lower, columns = np.zeros((n, n)), np.unique(right["bj"])
        lower[left["ti"], left["tj"]] = left["tv"]
        x = np.zeros((n, len(columns)))
        x[right["bi"], np.searchsorted(columns, right["bj"])] = right["bv"]
        x = forward(lower, x)
        return pd.DataFrame({"i": np.repeat(np.arange(n), len(columns)), "j": np.tile(columns, n), "v": x.ravel()})

    return rhs.groupBy("bg").cogroup(tri.groupBy("tg")).applyInPandas(solve, MAT)


def _inverses(diagonal: DataFrame, n: int, block: int) -> DataFrame:
    """s, i, j, v: the inverses of the blocks (s, i, j, v), each in one task; i and j count from the block's corner."""

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["s"].iloc[0])
        size = min(block, n - s * block)
        lower = np.zeros((size, size))
        lower[rows["i"] - s * block, rows["j"] - s * block] = rows["v"]
        inverse = np.tril(forward(lower, np.eye(size)))
        i, j = np.tril_indices(size)
        return pd.DataFrame({"s": s, "i": i, "j": j, "v": inverse[i, j]})

    return diagonal.groupBy("s").applyInPandas(invert, f"s long, {MAT}")


def _stepwise(a: DataFrame, b: DataFrame, n: int, cols: int, block: int) -> DataFrame:
    spark, at = a.sparkSession, lambda c: (F.col(c) / block).cast("long")
    folder, steps = fresh_dir(a.sparkSession, "solve"), -(-n // block)

    def keep(df: DataFrame, name: str) -> DataFrame:
        """By rows of blocks: a filter on s reads one folder."""
        spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != "v"]), F.lit(max(1, -(-n // (4 * block)))))
        df.repartition("s", spread).write.partitionBy("s").parquet(f"{folder}/{name}")
        return spark.read.schema(f"{MAT}, s long").parquet(f"{folder}/{name}")

    t = a.withColumn("s", at("i"))
    inverses = keep(_inverses(t.where(at("j") == F.col("s")).select("s", "i", "j", "v"), n, block), "inverse")
    below = keep(t.where(at("j") < F.col("s")), "triangle")
    rhs = keep(b.select("i", "j", "v", at("i").alias("s")), "rhs")
    for s in range(steps):
        size, mine = min(block, n - s * block), F.col("s") == s
        local = (F.col("i") - s * block).alias("i")
        right = rhs.where(mine).select(local, "j", "v")
        if s:
            known = spark.read.schema(MAT).parquet(*[f"{folder}/x/{k}" for k in range(s)])
            gone = product(below.where(mine).select(local, "j", "v"), known, size=(size, cols, s * block))
            right = right.join(gone, ["i", "j"], "left").select("i", "j", (F.col("v") - F.coalesce("p", F.lit(0.0))).alias("v"))
        x = product(inverses.where(mine).select("i", "j", "v"), right, size=(size, cols, size))
        x.select((F.col("i") + s * block).alias("i"), "j", F.col("p").alias("v")).write.mode("overwrite").parquet(f"{folder}/x/{s}")
    return spark.read.schema(MAT).parquet(*[f"{folder}/x/{k}" for k in range(steps)])


def _at_once(a: DataFrame, b: DataFrame, n: int, cols: int, block: int) -> DataFrame:
    """By way of the interface; in steps where that is too large."""
    if n <= block:
        return _whole(a, b, n, cols)
    spark, folder, at = a.sparkSession, fresh_dir(a.sparkSession, "solve"), lambda c: (F.col(c) / block).cast("long")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    reads = keep(a.select(at("i").alias("s"), "j").where(at("j") < F.col("s")).distinct(), "reads")
    most = reads.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    size = reads.select("j").distinct().count()
    if most > READ * block or size > PART * n:
        return _stepwise(a, b, n, cols, block)
    a, b = keep(a.select("i", "j", "v"), "triangle"), keep(b.select("i", "j", "v"), "rhs")

    # numbers of the interface's unknowns in their order: those of earlier blocks, and earlier ones of the same block
    inside = reads.select("j").distinct().withColumn("s", at("j"))
    before = inside.groupBy("s").count().select(F.col("s"), F.coalesce(F.sum("count").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = inside.join(before, "s").select("s", "j", (F.col("before") + F.row_number().over(Window.partitionBy("s").orderBy("j")) - 1).alias("number"))
    numbered = keep(numbered, "interface")
    read = reads.join(numbered.select("j", "number"), "j")

    groups = max(1, -(-cols // TOGETHER))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    no = F.lit(0.0)

    def kind(df: DataFrame, what: int, s, g, i, j, v) -> DataFrame:
        return df.select(s.alias("s"), g.alias("g"), F.lit(what).alias("kind"), i.alias("i"), j.alias("j"), v.alias("v"))

    i, j, v, s, number, group = F.col("i"), F.col("j"), F.col("v"), F.col("s"), F.col("number"), (F.col("j") / TOGETHER).cast("int")
    own = kind(a, TRIANGLE, at("i"), every, i, j, v).unionByName(kind(b, RIGHT, at("i"), group, i, j, v))

    def system(rows: pd.DataFrame) -> tuple:
        """The block's corner, its first column, triangle and right-hand sides, and places, columns and values of what it reads."""
        corner, first = int(rows["s"].iloc[0]) * block, int(rows["g"].iloc[0]) * TOGETHER
        what, i, j, v = (rows[c].to_numpy() for c in ("kind", "i", "j", "v"))
        size, width = min(block, n - corner), min(TOGETHER, cols - first)
        lower, right = np.zeros((size, size)), np.zeros((size, width))
        near, far, rhs = (what == TRIANGLE) & (j >= corner), (what == TRIANGLE) & (j < corner), what == RIGHT
        lower[i[near] - corner, j[near] - corner] = v[near]
        right[i[rhs] - corner, j[rhs] - first] = v[rhs]
        return corner, first, lower, right, i[far] - corner, j[far], v[far]

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows[rows["kind"] == OWN]
        if not len(mine):
            return pd.DataFrame({"kind": [], "i": [], "j": [], "v": []}).astype({"kind": "int32", "i": "int64", "j": "int64", "v": "float64"})
        corner, first, lower, right, at, column, value = system(rows)
        width, others = right.shape[1], rows[rows["kind"] == READS].sort_values("i")
        factors = np.zeros((len(lower), len(others)))
        if len(others):
            factors[at, np.searchsorted(others["i"], column)] = value
        x = forward(lower, np.hstack((right, factors)))[mine["i"].to_numpy() - corner]
        mine, others = mine["j"].to_numpy(), others["j"].to_numpy()
        out = [(RIGHT, np.repeat(mine, width), np.tile(first + np.arange(width), len(mine)), x[:, :width].ravel())]
        if first == 0:
            out += [(TRIANGLE, mine, mine, np.ones(len(mine))), (TRIANGLE, np.repeat(mine, len(others)), np.tile(others, len(mine)), x[:, width:].ravel())]
        return pd.concat([pd.DataFrame({"kind": np.full(len(i), k, np.int32), "i": i, "j": j, "v": v}) for k, i, j, v in out])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        corner, first, lower, right, at, column, value = system(rows)
        known, columns = rows[rows["kind"] == KNOWN], np.unique(column)
        factors, x = np.zeros((len(lower), len(columns))), np.zeros((len(columns), right.shape[1]))
        factors[at, np.searchsorted(columns, column)] = value
        x[np.searchsorted(columns, known["i"]), known["j"].to_numpy() - first] = known["v"]
        with np.errstate(all="ignore"):
            right -= factors @ x
        size, width = right.shape
        return pd.DataFrame({"i": np.repeat(corner + np.arange(size), width), "j": np.tile(first + np.arange(width), size), "v": forward(lower, right).ravel()})

    asked = own.unionByName(kind(numbered, OWN, s, every, j, number, no)).unionByName(kind(read, READS, s, F.lit(0), j, number, no))
    reduced = keep(asked.groupBy("s", "g").applyInPandas(reduce, f"kind int, {MAT}"), "reduced")
    x = _at_once(*(reduced.where(F.col("kind") == k).select("i", "j", "v") for k in (TRIANGLE, RIGHT)), size, cols, block)
    # new names, as the solution's lineage holds columns of these names
    x = x.select(F.col("i").alias("xi"), F.col("j").alias("xj"), F.col("v").alias("xv"))
    known = kind(read.join(x, F.col("number") == F.col("xi")), KNOWN, s, (F.col("xj") / TOGETHER).cast("int"), j, F.col("xj"), F.col("xv"))
    return own.unionByName(known).groupBy("s", "g").applyInPandas(finish, MAT)


def solve(uplo: str, trans: str, diag: str, n: int, cols: int, a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """X (i, j, v) of op(A) X = B, for n unknowns and ``cols`` right-hand sides.

    A zero on the diagonal makes infinities and NaN, in a blocked solve also in other rows of its block, and of blocks that read it.
    """
    nonnegative(n=n, cols=cols)
    lower = (flag(uplo, "ul", "uplo") == "l") != transposed(trans)
    t = triangle(a, uplo, diag)
    if transposed(trans):
        t = transpose(t)
    turn = F.lit(n - 1)
    if not lower:
        t = t.select((turn - F.col("i")).alias("i"), (turn - F.col("j")).alias("j"), "v")
        b = b.select((turn - F.col("i")).alias("i"), "j", "v")
    x = _at_once(t, b, n, cols, block)
    return x if lower else x.select((turn - F.col("i")).cast("long").alias("i"), "j", "v")


def solve_vector(uplo: str, trans: str, diag: str, n: int, a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    return solve(uplo, trans, diag, n, 1, a, b.select("i", F.lit(0).cast("long").alias("j"), "v"), block).select("i", "v")
