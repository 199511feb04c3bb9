"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(256 x).  Candidates are dealt into shards and stand in vertical layout (dimension by dimension)
inside a block of ``BLOCK`` rows.  For a query the inner products of a block are accumulated ``STEP`` dimensions at a time; after
each step a candidate whose partial sum plus the largest possible rest (the product of the remaining norms) is below the query's
k-th best so far is dropped and the survivors are compacted.  Dimensions are taken in the order of their mass in the block, so
that bounds close early.  Nothing is lost: a candidate goes only when it can't reach the k-th score.

Queries and candidates meet on a grid: query blocks are written once for each shard of candidates, candidates once for each
group of query blocks, and the pairs meet by an equi-join's key (shard, query group), block by block.  Neither side is broadcast.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part; scores are
between vectors of equal length; a query is matched with every other row but itself (rows that repeat its id count as
itself); of rows that repeat an id the candidate with the best score counts; ties go to the smaller id; fewer than k candidates: all
of them; extra columns are ignored; an empty table gives an empty result.  Sums are exact while they stay within 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow

K, SCALE, BLOCK, STEP = 5, 256, 4096, 16
#: Rows that a shard of candidates, and a group of queries, have on average.
SHARD_ROWS, GROUP_ROWS = 16_384, 1024
SCHEMA = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q (array of long): the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


class Best:
    """The k best (score, id) of each of some queries, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def floor(self, i: int) -> int | None:
        return int(self.scores[i][-1]) if len(self.scores[i]) >= self.k else None

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 8 * self.k and (len(self.scores[i]) < self.k):  # the k-th of the new ones bounds what can stay
            cutoff = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            # repeated ids could fill those places, then all are looked at
            near = scores >= cutoff
            if len(np.unique(ids[near])) >= self.k:
                scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate((self.scores[i], scores)), np.concatenate((self.ids[i], ids))
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: self.k]
        self.scores[i], self.ids[i] = scores[first], ids[first]


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, best: Best, step: int = STEP) -> int:
    """Adds a block of candidates (rows) to the queries' best; returns the products taken, for tests of the pruning."""
    whole = np.abs(block).max(initial=0.0) * np.abs(queries).max(initial=0.0) * block.shape[1]
    kind = np.float64 if whole < 2**52 else np.int64
    mass = np.square(block.astype(np.float64))
    order = np.argsort(-mass.sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(block.astype(kind)[:, order].T)  # vertical: a row per dimension
    q = queries.astype(kind)[:, order]
    cuts = list(range(0, columns.shape[0], step))
    rest = [np.sqrt(mass[:, order[c + step :]].sum(axis=1)) * (1 + 1e-9) for c in cuts]
    q_rest = [np.sqrt(np.square(q[:, c + step :].astype(np.float64)).sum(axis=1)) * (1 + 1e-9) for c in cuts]
    # the first block of dimensions is taken for all queries at once: no candidate can be dropped before it
    first = q[:, :step] @ columns[:step]
    done = first.size * min(step, columns.shape[0])
    for i in range(len(q)):
        partial, alive = first[i], None
        for n, c in enumerate(cuts):
            if n:
                block_now = columns[c : c + step] if alive is None else columns[c : c + step, alive]
                partial = partial + q[i, c : c + step] @ block_now
                done += block_now.size
            floor = best.floor(i)
            if floor is not None:
                bound = partial + q_rest[n][i] * (rest[n] if alive is None else rest[n][alive])
                stay = bound >= floor - 1e-6 * (1 + abs(floor))
                if not stay.all():
                    alive = np.flatnonzero(stay) if alive is None else alive[stay]
                    partial = partial[stay]
                    if not len(alive):
                        break
        if alive is None or len(alive):
            who = ids if alive is None else ids[alive]
            other = who != query_ids[i]
            best.add(i, partial[other].astype(np.int64), who[other])
    return done


def search(embeddings: DataFrame, every: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the queries: rows whose id is divisible by ``every``."""
    rows = cut(quantised(embeddings, scale))
    sizes = rows.agg(F.count("*").alias("n"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")).alias("q")).first()
    shards, groups = max(1, -(-sizes["n"] // SHARD_ROWS)), max(1, -(-(sizes["q"] or 0) // GROUP_ROWS))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates()
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part(groups, "q").alias("grp"), F.lit(0).alias("side"), "vec_id", "q")
    given = rows.select(part(shards, "c").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("side"), "vec_id", "q")
    met = asked.unionByName(given).repartition("shard", "grp").sortWithinPartitions("shard", "grp", "side", "vec_id")

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, asked_now, given_now in _meetings(parts):
            yield from _answers(asked_now, given_now, k)

    found = map_arrow(met.select("shard", "grp", "side", "vec_id", "q"), f, SCHEMA)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # a limit on row_number() is applied before the shuffle too, so k rows of a query leave each task
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def _meetings(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, Iterator]]:
    """For each (shard, group) its queries, and its candidates in blocks of one length."""
    rows = (r for b in parts for r in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True))
    held = next(rows, None)
    while held is not None:
        key, asked = held[:2], []
        while held is not None and held[:2] == key and held[2] == 0:
            asked.append((held[3], held[4]))
            held = next(rows, None)

        def given() -> Iterator[list]:
            nonlocal held
            block: list = []
            while held is not None and held[:2] == key:
                block.append((held[3], held[4]))
                held = next(rows, None)
                if len(block) >= BLOCK:
                    yield block
                    block = []
            if block:
                yield block

        blocks = given()
        yield key, asked, blocks
        for _ in blocks:  # what wasn't taken
            pass


def _answers(asked: list, blocks: Iterator[list], k: int) -> Iterator[pa.RecordBatch]:
    by_length: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}
    for n in {len(q) for _, q in asked}:
        mine = [(i, q) for i, q in asked if len(q) == n]
        by_length[n] = (np.array([q for _, q in mine], np.int64), np.array([i for i, _ in mine], np.int64), Best(len(mine), k))
    for block in blocks:
        for n, (q, ids, best) in by_length.items():
            mine = [(i, v) for i, v in block if len(v) == n]
            if mine:
                search_block(q, ids, np.array([v for _, v in mine], np.int64), np.array([i for i, _ in mine], np.int64), best)
    for q, ids, best in by_length.values():
        out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([np.full(len(best.ids[i]), ids[i]) for i in range(len(q))], best.ids, best.scores)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])
