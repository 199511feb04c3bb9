"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader, scored as sparse dot products.

Defined results: a null text counts as empty; an empty text gets the score of the bias alone; a null ``doc_id`` is never
held out; rows are scored one by one, so ties, repeated rows and extra columns change nothing; no labelled rows: every score
is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import few, map_arrow, strings
from tessera.llm.ngram_model import Featurizer, Logistic, Sparse, fit_ftrl

#: The bounds of the labelled sample that ``fit`` reads, and of a shard, on average, of all labelled rows, which ``fit_all`` reads.
MAX_ROWS, MAX_CHARS = 12_000, 60_000_000
THRESHOLD = 0.3
BITS = 20


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _known(labels: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and labels of the ids that models may learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in columns])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _sizes(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, characters and labels of documents that models may learn from."""
    return texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).join(known, "doc_id")


def labelled_sample(documents: DataFrame, labels: DataFrame, columns: list[str], max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> list[tuple]:
    """(text, label, ...) of documents with labels that aren't held out, in the order of a hash of their ids.

    At most ``max_rows`` rows and ``max_chars`` characters: what the driver gathers is bounded.  Labels without a document take no place.  A
    text that doesn't fit into what is left of the characters is passed over.  Labels that repeat an id count as the largest of each
    column, and of documents that repeat it the largest text is taken.
    """
    spark = documents.sparkSession
    known, texts = _known(labels, columns), _texts(documents)
    sizes = _sizes(texts, known)
    chosen, total = [], 0
    for r in sizes.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(max_rows).select("at", "doc_id", "n", *columns).collect():
        if total + r["n"] <= max_chars:
            total += r["n"]
            chosen.append((r["at"], r["doc_id"], *(r[c] for c in columns)))
    if not chosen:
        return []
    schema = f"at long, doc_id long, {', '.join(f'{c} int' for c in columns)}"
    # max_rows narrow rows at most, so they may be broadcast
    rows = texts.join(F.broadcast(spark.createDataFrame(chosen, schema)), "doc_id").groupBy("doc_id", "at", *columns).agg(F.max("text").alias("text")).toArrow()
    out = sorted(zip(*(rows.column(c).to_pylist() for c in ("at", "doc_id", "text", *columns)), strict=True))
    del rows
    pa.default_memory_pool().release_unused()
    return [x[2:] for x in out]


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, bits: int = BITS) -> Logistic:
    rows = labelled_sample(documents, labels, ["quality"], max_rows, max_chars)
    x, y = Featurizer(bits).transform([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    del rows
    return fit_ftrl(x, y, bits)


def shards_of(documents: DataFrame, labels: DataFrame, columns: list[str], max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> int:
    """How many shards of the bounds all labelled rows make that aren't held out."""
    rows, chars = _sizes(_texts(documents), _known(labels, columns)).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return max(-(-rows // max_rows), -(-chars // max_chars))


#: Weights are added up as whole multiples of its inverse, so that the order of the shards changes nothing.
_UNIT = float(1 << 40)


def fit_shards(documents: DataFrame, labels: DataFrame, columns: list[str], shards: int, features: Callable[[], Featurizer], targets: Callable[[np.ndarray], list[np.ndarray]], bits: int, **ftrl: float) -> list[Logistic]:
    """A model for each target, from every labelled row that isn't held out: the mean of the models of shards, each fitted by a task.

    Rows are dealt to shards by a hash of their ids.  ``targets`` gives the target vectors for an array of rows of labels.  Repeated labels
    and documents count as in ``labelled_sample``.  Features of a shard are held in memory, its texts aren't.
    """
    known, texts = _known(labels, columns), _texts(documents)
    ids = few(known.select("doc_id"))
    if ids is not None:  # texts without labels go early where that takes no shuffle, else after it
        texts = texts.join(ids, "doc_id", "left_semi")
    rows = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", *[F.lit(None).cast("int").alias(c) for c in columns])
    # a union and not a join, so that texts are shuffled once, to their shard
    rows = rows.unionByName(known.withColumn("text", F.lit(None).cast("string")))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"), F.xxhash64("doc_id").alias("at"), "*")
    rows = rows.repartition(4 * shards, "shard").groupBy("shard", "at", "doc_id").agg(F.max("text").alias("text"), *[F.max(c).alias(c) for c in columns])
    rows = rows.where(F.col("text").isNotNull() & F.col(columns[0]).isNotNull()).sortWithinPartitions("shard", "at", "doc_id")

    def fitted(x: list[Sparse], y: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = Sparse.stacked(x)
        for k, target in enumerate(targets(np.concatenate(y))):
            model = fit_ftrl(whole, target, bits, **ftrl)
            at = np.flatnonzero(model.weights)
            units = np.rint(np.append(model.weights[at].astype(np.float64), model.bias) * _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(units)], ["model", "bucket", "units"])

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, current, x, y = features(), None, [], []
        for b in parts:
            shard = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if shard[lo] != current and x:
                    yield from fitted(x, y)
                    x, y = [], []
                current, own = shard[lo], b.slice(lo, hi - lo)
                x.append(maker.transform(strings(own.column(1))))
                y.append(np.stack([own.column(2 + k).to_numpy() for k in range(len(columns))], axis=1))
        if x:
            yield from fitted(x, y)

    models = map_arrow(rows.select("shard", "text", *columns), f, "model int, bucket int, units long")
    sums = models.groupBy("model", "bucket").agg(F.sum("units").alias("units"), F.count("*").alias("n")).toArrow()  # fixed by bits: a row a weight at most
    model, bucket, units, n = (sums.column(c).to_numpy() for c in ("model", "bucket", "units", "n"))
    out = []
    for k in range(len(targets(np.zeros((0, len(columns)), np.int32)))):
        own, weights = (model == k) & (bucket >= 0), np.zeros(1 << bits)
        last = (model == k) & (bucket < 0)  # the biases: one of each shard
        seen = max(1, int(n[last].sum()))
        weights[bucket[own]] = units[own] / _UNIT / seen
        out.append(Logistic(weights.astype(np.float32), float(units[last].sum() / _UNIT / seen)))
    return out


def fit_all(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, bits: int = BITS) -> Logistic:
    """``fit`` where the bounds hold all labelled rows that aren't held out, else the mean of the models of their shards."""
    shards = shards_of(documents, labels, ["quality"], max_rows, max_chars)
    if shards <= 1:
        return fit(documents, labels, max_rows, max_chars, bits)
    return fit_shards(documents, labels, ["quality"], shards, lambda: Featurizer(bits), lambda y: [y[:, 0].astype(float)], bits)[0]


class _Scorer:
    """Holds a broadcast model on the executors; its size is fixed by ``bits``."""

    def __init__(self, spark: SparkSession, model: Logistic, bits: int):
        self.model, self.bits = spark.sparkContext.broadcast(model), bits

    def __call__(self, parts: Iterator[pa.RecordBatch], text_of) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        model, features = self.model.value, Featurizer(self.bits)
        for b in parts:
            yield b, model.score(features.transform(strings(text_of(b))))


def score(documents: DataFrame, model: Logistic, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scorer = _Scorer(documents.sparkSession, model, bits)

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in scorer(parts, lambda b: b.column(1)):
            out = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), f, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Logistic, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows, with all their columns, whose texts score at least the threshold."""
    scorer, at = _Scorer(documents.sparkSession, model, bits), documents.columns.index("text")

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in scorer(parts, lambda b: b.column(at)):
            yield b.filter(pa.array(s >= threshold))

    return map_arrow(documents, f, documents.schema)
