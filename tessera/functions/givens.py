"""Plane rotations: parameters as expressions (rotg) and by a pandas UDF (rotmg, whose rescaling repeats)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import ieee_divide

GAMMA = 4096.0
ROTMG = "d1 double, d2 double, x1 double, flag double, h11 double, h21 double, h12 double, h22 double"


def rotg(a: Column, b: Column) -> dict[str, Column]:
    """r, z, c, s: c*a + s*b = r, -s*a + c*b = 0; z encodes c and s."""
    big = F.when(F.abs(a) > F.abs(b), a).otherwise(b)
    r = F.when(big < 0, -F.hypot(a, b)).otherwise(F.hypot(a, b))
    c = F.when(r == 0, 1.0).otherwise(ieee_divide(a, r))
    s = F.when(r == 0, 0.0).otherwise(ieee_divide(b, r))
    z = F.when(F.abs(a) >= F.abs(b), s).when(c != 0, ieee_divide(F.lit(1.0), c)).otherwise(1.0)
    return {"r": r, "z": z, "c": c, "s": s}


def rotm_matrix(param: list[float]) -> tuple[float, float, float, float]:
    """h11, h12, h21, h22 of [flag, h11, h21, h12, h22]; a flag of no meaning uses the matrix as given."""
    flag, h11, h21, h12, h22 = map(float, param)
    if flag == -2:
        return 1.0, 0.0, 0.0, 1.0
    if flag == 0:
        return 1.0, h12, h21, 1.0
    if flag == 1:
        return h11, 1.0, -1.0, h22
    return h11, h12, h21, h22


def rotmg_values(d1: float, d2: float, x1: float, y1: float) -> tuple[float, ...]:
    """d1, d2, x1, flag, h11, h21, h12, h22 of the modified rotation that zeroes y1.

    The weights are kept within gamma**-2 .. gamma**2 by powers of gamma, which turn the flag to -1 (a full matrix); a negative
    weight that can't be used zeroes everything.
    """
    nothing = (0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0)
    if d1 < 0:
        return nothing
    if d2 == 0 or y1 == 0:
        return d1, d2, x1, -2.0, 1.0, 0.0, 0.0, 1.0
    p1, p2 = d1 * x1, d2 * y1
    q1, q2 = p1 * x1, p2 * y1
    if d2 > 0 and (d1 == 0 or x1 == 0):  # only y1 counts: the two change places
        flag, h11, h21, h12, h22 = 1.0, 0.0, -1.0, 1.0, 0.0
        d1, d2, x1 = d2, d1, y1
    elif abs(q1) > abs(q2):
        flag, h11, h21, h12, h22 = 0.0, 1.0, -y1 / x1, p2 / p1, 1.0
        u = 1 - h12 * h21
        if u <= 0:
            return nothing
        d1, d2, x1 = d1 / u, d2 / u, x1 * u
    else:
        if q2 < 0 or p2 == 0:
            return nothing
        flag, h11, h21, h12, h22 = 1.0, p1 / p2, -1.0, 1.0, x1 / y1
        u = 1 + h11 * h22
        if u < 1:
            return nothing
        d1, d2, x1 = d2 / u, d1 / u, y1 * u
    low, high = GAMMA**-2, GAMMA**2
    while d1 != 0 and not low < abs(d1) <= high and math.isfinite(d1):
        flag, up = -1.0, abs(d1) <= low
        k = GAMMA if up else 1 / GAMMA
        d1, x1, h11, h12 = d1 * k * k, x1 / k, h11 / k, h12 / k
    while d2 != 0 and not low < abs(d2) <= high and math.isfinite(d2):
        flag, up = -1.0, abs(d2) <= low
        k = GAMMA if up else 1 / GAMMA
        d2, h21, h22 = d2 * k * k, h21 / k, h22 / k
    return d1, d2, x1, flag, h11, h21, h12, h22


def rotmg(d1: Column, d2: Column, x1: Column, y1: Column) -> Column:
    """The struct ``ROTMG`` of each row."""

    @F.pandas_udf(ROTMG)
    def each(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rotmg_values(*x) for x in zip(a, b, c, d, strict=True)], columns=["d1", "d2", "x1", "flag", "h11", "h21", "h12", "h22"], dtype=float)

    return each(d1, d2, x1, y1)
