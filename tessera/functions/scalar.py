"""The scalar functors: unary and binary Column expressions, and associative reductions with their identities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def ieee_divide(a: Column, b: Column) -> Column:
    """Division as floating-point hardware does it; SQL would fail for a zero divisor."""
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(_INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


UNARY: dict[str, Callable[[Column], Column]] = {
    "absolute": F.abs,
    "zero": lambda x: F.lit(0.0),
    "one": lambda x: F.lit(1.0),
    "identity": lambda x: x,
    "sign": F.signum,
    "negation": lambda x: -x,
    "sqrt": F.sqrt,
    "double": lambda x: x + x,
    "square": lambda x: x * x,
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "product": lambda a, b: a * b,
    "division": ieee_divide,
    "mean": lambda a, b: a + b,  # the division by the count comes with the reduction
    "max": lambda a, b: F.when(a > b, a).otherwise(b),
    "min": lambda a, b: F.when(a < b, a).otherwise(b),
    "absolute_add": lambda a, b: F.abs(a) + F.abs(b),
    "hypotenuse": F.hypot,
}


def collapse_index(outer: Column, inner: Column, scale: int) -> Column:
    """One index for a nested pair."""
    return outer * scale + inner


@dataclass(frozen=True)
class Reduction:
    """An aggregate, and its value for no elements."""

    aggregate: Callable[[Column], Column]
    identity: float

    def __call__(self, x: Column) -> Column:
        return F.coalesce(self.aggregate(x), F.lit(self.identity))


REDUCTIONS: dict[str, Reduction] = {
    "add": Reduction(F.sum, 0.0),
    "absadd": Reduction(lambda x: F.sum(F.abs(x)), 0.0),
    "product": Reduction(F.product, 1.0),
    "min": Reduction(F.min, 1.7976931348623157e308),
    "max": Reduction(F.max, -1.7976931348623157e308),
    "mean": Reduction(F.avg, 0.0),
}


def arg_max(i: Column, v: Column) -> Column:
    """The smallest index of the largest magnitude, NaN aside; 0 for no elements."""
    ok = ~F.isnan(v)
    return F.coalesce(-F.max(F.when(ok, F.struct(F.abs(v).alias("m"), (-i).alias("k"))))["k"], F.lit(0)).cast("long")


def arg_min(i: Column, v: Column) -> Column:
    ok = ~F.isnan(v)
    return F.coalesce(F.min(F.when(ok, F.struct(F.abs(v).alias("m"), i.alias("k"))))["k"], F.lit(0)).cast("long")
