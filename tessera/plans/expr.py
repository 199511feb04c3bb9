"""Expression trees over vectors: nodes compose, and a whole tree becomes one projection or one aggregate.

    tree = Assign("out", BinaryOp("add", ScalarOp("product", 2.0, Vector(x)), Assign("kept", Vector(y))))
    evaluate(tree)            # i, kept, out: one join of the leaves, one select

An assignment gives its value, so it nests as an operand; every one is a column of the result.  New functors are plain Python
functions of Columns, put into ``UNARY``, ``BINARY`` or ``REDUCTIONS`` of ``tessera.functions.scalar``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import BINARY, REDUCTIONS, UNARY, arg_max, arg_min, collapse_index


@dataclass(frozen=True, eq=False)
class Vector:
    data: DataFrame


@dataclass(frozen=True, eq=False)
class UnaryOp:
    op: str
    rhs: Any


@dataclass(frozen=True, eq=False)
class ScalarOp:
    op: str
    scalar: float
    rhs: Any


@dataclass(frozen=True, eq=False)
class BinaryOp:
    op: str
    lhs: Any
    rhs: Any


@dataclass(frozen=True, eq=False)
class TupleOp:
    """(index, value)."""

    rhs: Any


@dataclass(frozen=True, eq=False)
class Collapse:
    """A nested tuple with one index: outer * scale + inner."""

    outer: Any
    scale: int


@dataclass(frozen=True, eq=False)
class Assign:
    name: str
    rhs: Any


@dataclass(frozen=True, eq=False)
class DoubleAssign:
    """Both right sides are read before either is written."""

    first: str
    second: str
    rhs1: Any
    rhs2: Any


@dataclass(frozen=True, eq=False)
class Join:
    """Two trees, one after the other."""

    lhs: Any
    rhs: Any


class _Builder:
    def __init__(self) -> None:
        self.leaves: list[DataFrame] = []
        self.columns: dict[str, Column] = {}

    def leaf(self, data: DataFrame) -> Column:
        for k, known in enumerate(self.leaves):
            if known is data:
                return F.col(f"_leaf{k}")
        self.leaves.append(data)
        return F.col(f"_leaf{len(self.leaves) - 1}")

    def build(self, node: Any) -> Column:
        if isinstance(node, Vector):
            return self.leaf(node.data)
        if isinstance(node, UnaryOp):
            return UNARY[node.op](self.build(node.rhs))
        if isinstance(node, ScalarOp):
            return BINARY[node.op](F.lit(float(node.scalar)), self.build(node.rhs))
        if isinstance(node, BinaryOp):
            return BINARY[node.op](self.build(node.lhs), self.build(node.rhs))
        if isinstance(node, TupleOp):
            return F.struct(F.col("i").alias("ind"), self.build(node.rhs).alias("val"))
        if isinstance(node, Collapse):
            t = self.build(node.outer)
            return F.struct(collapse_index(t["ind"], t["val"]["ind"], node.scale).alias("ind"), t["val"]["val"].alias("val"))
        if isinstance(node, Assign):
            value = self.build(node.rhs)
            self.columns[node.name] = value
            return value
        if isinstance(node, DoubleAssign):
            a, b = self.build(node.rhs1), self.build(node.rhs2)
            self.columns |= {node.first: a, node.second: b}
            return a
        if isinstance(node, Join):
            self.build(node.lhs)
            return self.build(node.rhs)
        raise TypeError(f"not a node: {node!r}")

    def joined(self) -> DataFrame:
        if not self.leaves:
            raise ValueError("a tree needs a vector")
        out = None
        for k, d in enumerate(self.leaves):
            part = d.select("i", F.col("v").alias(f"_leaf{k}"))
            out = part if out is None else out.join(part, "i")
        return out


def evaluate(tree: Any) -> DataFrame:
    """i and a column for every assignment (``v`` for a tree without any)."""
    b = _Builder()
    value = b.build(tree)
    columns = b.columns or {"v": value}
    return b.joined().select("i", *[c.alias(n) for n, c in columns.items()])


def reduce(op: str, tree: Any) -> DataFrame:
    """One row, v: an associative reduction of a tree (``REDUCTIONS``, or ``iamax`` and ``iamin``)."""
    b = _Builder()
    value = b.build(tree)
    rows = b.joined().select("i", value.alias("v"))
    if op in ("iamax", "iamin"):
        return rows.agg({"iamax": arg_max, "iamin": arg_min}[op](F.col("i"), F.col("v")).alias("v"))
    return rows.agg(REDUCTIONS[op](F.col("v")).alias("v"))
