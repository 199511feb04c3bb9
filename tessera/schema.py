"""Schemas of the operands.

Vec   i, v          a dense vector
Mat   i, j, v       a dense matrix, zeros written out, so that NaN and infinities meet every partner they should
Batch b, i, j, v    equally shaped matrices
Buf   pos, v        flat memory; views (``tessera.plans.views``) read increments, leading dimensions, bands and packed triangles from it
"""

from __future__ import annotations

VEC = "i long, v double"
MAT = "i long, j long, v double"
BATCH = "b long, i long, j long, v double"
BUF = "pos long, v double"


def flag(value: str, allowed: str, what: str) -> str:
    """A one-letter flag in lower case; ``ValueError`` for any other letter."""
    x = value.lower() if isinstance(value, str) else ""
    if len(x) != 1 or x not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return x


def transposed(trans: str) -> bool:
    """n: no; t and c: yes (for real elements they are the same)."""
    return flag(trans, "ntc", "trans") != "n"


def positive(**sizes: int) -> None:
    for name, n in sizes.items():
        if n <= 0:
            raise ValueError(f"{name} must be positive, not {n}")


def nonnegative(**sizes: int) -> None:
    for name, n in sizes.items():
        if n < 0:
            raise ValueError(f"{name} must not be negative, not {n}")
