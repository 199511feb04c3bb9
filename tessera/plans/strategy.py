"""Choices that Catalyst can't make: strategies by shape, folders that all executors share, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this number of multiplications a product is an equi-join of elements; above it, tiles meet on a grid.
ELEMENT_WORK = 1 << 24
TILE = 256


def shape(a: DataFrame, b: DataFrame) -> tuple[int, int, int]:
    """(m, n, k) of A B, read from the operands' largest indices: an aggregate of a row over each of them."""
    m, k = a.agg(F.max("i"), F.max("j")).first()
    n, k2 = b.agg(F.max("j"), F.max("i")).first()
    return tuple(0 if x is None else int(x) + 1 for x in (m, n, max((x for x in (k, k2) if x is not None), default=None)))


def product_strategy(m: int, n: int, k: int, strategy: str = "auto") -> str:
    if strategy not in ("auto", "elements", "tiles"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy != "auto":
        return strategy
    return "elements" if m * n * k <= ELEMENT_WORK else "tiles"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``.

    Where that is unset, one is made in local mode (tests, a laptop); on a cluster it is an error, as no folder of one machine will do.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not ((sc.master or "").startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint into the shared folder: later reads survive the loss of an executor and of its shuffle files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)
