"""What the pipeline operators share: shared folders, names of helper columns, Arrow helpers, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.strategy import cut, fresh_dir, shared_dir

__all__ = ["BLANKS", "SYMBOLS", "RunHashes", "cut", "few", "free_names", "fresh_dir", "map_arrow", "shared_dir", "strings", "strip_nulls", "wider"]

#: Rows in an Arrow batch handed to Python.  Whole texts pass through, so batches stay small.
BATCH_ROWS = 1024


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the DataFrame hasn't got, in any case: the given ones, with underscores where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Narrow rows (some numbers and a hash each) that may be sent to every task.
BROADCAST_ROWS = 1 << 18


def few(rows: DataFrame, most: int | None = None) -> DataFrame | None:
    """The rows, to be broadcast, where a count shows that they are few enough; else None."""
    return F.broadcast(rows) if rows.count() <= (BROADCAST_ROWS if most is None else most) else None


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts by rows, and by bytes where this Spark can.

    The settings are read when a query runs, so they stay in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def wider(schema: T.StructType, **fields: str) -> T.StructType:
    """The schema with more fields; ``StructType.add`` would change a DataFrame's own."""
    return T.StructType([*schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items())])


def strings(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty string."""
    out = column.to_pylist()
    return [x or "" for x in out] if column.null_count else out


def strip_nulls(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    out = column.cast(pa.binary()).to_pylist()
    return [x or b"" for x in out] if column.null_count else out


class RunHashes:
    """64-bit hashes of the runs of a text, without a Python object per word.

    A run is a longest stretch of bytes of one class; class 0 separates.  Its hash is the polynomial, modulo 2**64, of random
    values of its bytes, taken as a difference of prefix sums and then mixed; equal runs hash alike in every process.
    """

    def __init__(self, classes: np.ndarray):
        rng = np.random.default_rng(8191)
        self.classes = classes
        self.table = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.base = np.uint64(0x5851F42D4C957F2D)
        self.inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, self.base))))
        self.backs = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, self.inverse))))

    def of(self, raw: bytes) -> np.ndarray:
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint64)
        if n >= len(self.powers):
            self.grow(2 * n)
        b = np.frombuffer(raw, np.uint8)
        kind = self.classes[b]
        edges = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [n]))
        starts, ends = edges[:-1], edges[1:]
        kept = kind[starts] != 0
        starts, ends = starts[kept], ends[kept]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[b] * self.powers[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.backs[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


#: Words between blanks.
BLANKS = np.array([0 if x <= 32 else 1 for x in range(256)], np.uint8)
#: Words (ASCII letters, digits, underscores and all beyond ASCII) and runs of ASCII symbols.
SYMBOLS = np.array([0 if x <= 32 else 1 if x >= 128 or chr(x).isalnum() or chr(x) == "_" else 2 for x in range(256)], np.uint8)
