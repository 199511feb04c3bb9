"""Local data and tables to operands, and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import BUF


def _rows(spark: SparkSession, array: np.ndarray, names: tuple[str, ...]) -> DataFrame:
    import pandas as pd

    index = np.indices(array.shape).reshape(array.ndim, -1)
    frame = pd.DataFrame({n: index[k].astype(np.int64) for k, n in enumerate(names)} | {"v": array.ravel().astype(np.float64)})
    return spark.createDataFrame(frame, ", ".join(f"{n} long" for n in names) + ", v double")


def vector(spark: SparkSession, values) -> DataFrame:
    return _rows(spark, np.asarray(values, float), ("i",))


def matrix(spark: SparkSession, values) -> DataFrame:
    return _rows(spark, np.atleast_2d(np.asarray(values, float)), ("i", "j"))


def batch_matrix(spark: SparkSession, values) -> DataFrame:
    return _rows(spark, np.asarray(values, float), ("b", "i", "j"))


def buffer(spark: SparkSession, values) -> DataFrame:
    return _rows(spark, np.asarray(values, float).ravel(), ("pos",))


def fill(spark: SparkSession, n: int, value: float) -> DataFrame:
    """A buffer of n equal elements, made where it is used."""
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(float(value)).alias("v"))


def parquet_vector(spark: SparkSession, path: str, index: str, value: Column | str) -> DataFrame:
    """A vector from two columns of a table; only those are read."""
    v = F.col(value) if isinstance(value, str) else value
    return spark.read.parquet(path).select(F.col(index).cast("long").alias("i"), v.cast("double").alias("v"))


def matrix_of_rows(table: DataFrame, index: str, values: str) -> DataFrame:
    """A matrix from a table of row arrays."""
    return table.select(F.col(index).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def to_buffer(df: DataFrame, position: Column) -> DataFrame:
    return df.select(position.cast("long").alias("pos"), F.col("v").cast("double").alias("v")).to(df.sparkSession.createDataFrame([], BUF).schema)


def collect_vector(x: DataFrame, n: int) -> np.ndarray:
    """To the driver; for results of a known small size."""
    out = np.zeros(n)
    for r in x.select("i", "v").toLocalIterator():
        out[r["i"]] = r["v"]
    return out


def collect_matrix(a: DataFrame, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols))
    for r in a.select("i", "j", "v").toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out
