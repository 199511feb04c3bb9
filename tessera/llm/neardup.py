"""N-gram Jaccard join: an LSH forest of MinHash paths finds candidates, exact set overlap verifies them.

1. Every text becomes its set of five-word shingles (64-bit hashes); documents with the same set are one class representative
   with a number of copies.  A representative has a path of ``DEPTH`` symbols (16 bits of a minimum each) in each of ``TREES`` tries.
2. The tries are the paths in sorted order, over all partitions: rows are range-partitioned by (tree, path, representative), so a trie's
   hot branch may span tasks, and one streaming pass finds who shares a prefix with a neighbour.
3. Prefixes are shortened from the whole path down, symbol by symbol, until every link is found with the target probability: a prefix
   of length d finds a pair of similarity s with probability 1 - (1 - s**d)**trees, which is least at the threshold itself.  So the length
   follows from threshold, trees and target, and neither a sample of the rows nor an average over unlike links has a part in it.
4. Nodes with the same members are one.  Members of a node are compared with each other in a cell of their own, and a pair that shares
   several nodes counts in the smallest of them; where the nodes of a connected component hold more pairs than the component itself (a
   group of near copies meets in most trees), the component is the cell instead.  So no more pairs are compared than collide, with
   multiplicity, and chains of unlike documents don't become groups.  Large cells are cut into chunks by hash and verified chunk
   against chunk, so no task holds a whole hot group.
5. Verification is exact: intersections of all pairs of a cell are counted by sparse-to-block matrix products.  A cell gives one
   row per representative (links, smallest partner), never pairs.
6. Links are summed by representative; classes are the components of verified links.

Defined results: null and empty texts and null ids have no shingles and so no links, each is its own class; a text of one to
four words is one shingle; a document is an id with a shingle set, so rows that repeat an id with other sets are documents of
their own, and rows that repeat both are one; equal sets are linked at similarity 1; extra columns are ignored by ``join`` and kept by ``keep_one``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, RunHashes, cut, few, free_names, map_arrow, strings
from tessera.llm.graph import components_by_leaders

WORDS, THRESHOLD = 5, 0.8
#: The target is the probability that a link is found, for each link.
TREES, DEPTH, TARGET_RECALL = 32, 8, 1 - 1e-7
#: Representatives, and shingles, that a chunk of a large cell has on average at most.
CHUNK_ROWS, CHUNK_SHINGLES = 64, 2_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str, hashes: RunHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n lower-cased words between white space."""
    h = hashes.of(" ".join(text.lower().split()).encode())
    if not len(h):
        return h
    size = max(1, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(min(n, len(h))):
        out ^= out >> np.uint64(29)
        out = (out + h[k : k + size]) * _MULT[k % len(_MULT)]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def found(similarity: float | np.ndarray, length: int, trees: int = TREES) -> float | np.ndarray:
    """The probability that two sets share a prefix of the length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def matched_length(similarities: np.ndarray, weights: np.ndarray, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that finds the target share of the weighted pairs; 1 at least."""
    while depth > 1 and float(weights @ found(similarities, depth, trees)) < target * float(weights.sum()):
        depth -= 1
    return depth


class Signer:
    """MinHash paths: for each tree ``DEPTH`` minima, 16 bits of each, under multiply-add permutations of 32-bit hashes."""

    def __init__(self, trees: int):
        rng = np.random.default_rng(20240229)
        self.trees = trees
        self.a = rng.integers(0, 1 << 31, trees * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * DEPTH, np.uint32)

    def paths(self, s: np.ndarray) -> np.ndarray:
        """trees x 2 signed longs, each of four symbols, the first one highest."""
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            y = x[at : at + 512, None] * self.a
            y += self.b
            np.minimum(low, y.min(axis=0), out=low)
        symbols = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64).reshape(self.trees, 2, 4)
        return (symbols << np.array([48, 32, 16, 0], np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def _signatures(documents: DataFrame, trees: int) -> DataFrame:
    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = RunHashes(BLANKS), Signer(trees)
        none = np.zeros((0, 2), np.int64)
        for b in parts:
            keys, sizes, paths = [], [], []
            for text in strings(b.column(1)):
                s = shingles(text, hashes)
                keys.append(set_key(s) if len(s) else None)
                sizes.append(len(s))
                paths.append(signer.paths(s) if len(s) else none)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in paths]))).astype(np.int32))
            both = np.concatenate(paths) if paths else none
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(both[:, k]) for k in (0, 1)], ["hi", "lo"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "h", "set_key", "n", "paths"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), f, "doc_id long, h long, set_key binary, n long, paths array<struct<hi:long,lo:long>>")


def _matched(reps: DataFrame, length: int) -> DataFrame:
    """node, v of every representative that shares a prefix of the length with another: a pass over the sorted tries.

    The first and the last node of a partition may go on in the next one, so their members are given in any case.
    """
    order = ["tree", "hi", "lo", "v"]
    rows = reps.select("v", F.posexplode("paths").alias("tree", "path")).select("tree", "path.hi", "path.lo", "v")
    tries = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut_off = lambda symbols: np.int64(-1) << np.int64(64 - 16 * symbols) if symbols > 0 else np.int64(0)
    masks = cut_off(min(4, length)), cut_off(length - 4)

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        waiting: int | None = None  # the last row's representative, where it isn't known yet whether the next row is its neighbour
        for b in parts:
            if not b.num_rows:
                continue
            tree, hi, lo, v = (b.column(c).to_numpy(zero_copy_only=False) for c in order)
            node = (tree.astype(np.uint64) + np.uint64(1)) * _MULT[0]
            for part, mask, by in ((hi, masks[0], _MULT[1]), (lo, masks[1], _MULT[2])):
                node = (node ^ (part & mask).view(np.uint64)) * by
                node ^= node >> np.uint64(32)
            node = node.view(np.int64)
            if first is None:
                first = node[0]
            meets_next = np.append(node[1:] == node[:-1], False)
            meets_last = np.append(node[0] == last, meets_next[:-1])
            kept = meets_next | meets_last | (node == first)
            if waiting is not None and meets_last[0]:
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([waiting])], ["node", "v"])
            waiting = None if kept[-1] else int(v[-1])
            last = node[-1]
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(v[kept])], ["node", "v"])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([waiting])], ["node", "v"])

    return map_arrow(tries, f, "node long, v long")


def _length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix that finds each pair at the threshold or above with the target probability."""
    return matched_length(np.array([threshold]), np.ones(1), trees, depth, target)


def _buckets(matched: DataFrame) -> DataFrame:
    """v, dense, bucket: the cells in which a representative is compared, for rows (node, v).

    A cell is a component (dense) where its nodes hold more pairs than it does itself, else a node.
    """
    nodes = matched.groupBy("node").agg(F.min("v").alias("b"), F.count("*").alias("g"), F.bit_xor(F.xxhash64("v")).alias("members")).where("g > 1")
    nodes = nodes.groupBy("b", "g", "members").agg(F.min("node").alias("node")).select("node", "b", "g")
    # thousands may meet in a node or a component: what is known of these goes to all tasks where it is few, so that no task gets all members
    nodes = cut(nodes)
    led = cut(matched.join(few(nodes) or nodes, "node"))
    comps = cut(components_by_leaders(led.select("v", F.col("b").alias("leader"))).withColumnRenamed("label", "comp"))
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    by_nodes = led.where("v = b").join(comps, "v").groupBy("comp").agg(square("g").alias("pairs"))
    whole = comps.groupBy("comp").count().join(by_nodes, "comp").select("comp", (F.col("count").cast("double") * F.col("count") <= F.col("pairs")).alias("dense"))
    whole = cut(whole)
    kinds = comps.join(few(whole) or whole, "comp")
    return cut(led.join(kinds, "v").select("v", "dense", F.when(F.col("dense"), F.col("comp")).otherwise(F.col("node")).alias("bucket")).distinct())


class Cell:
    """Exact links between the members of a cell."""

    def __init__(self, threshold: float):
        t = Fraction(threshold).limit_denominator(1000)
        self.num, self.den = t.numerator, t.denominator

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        n = len(sets)
        out = np.zeros((n, n))
        values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], column[shared]
        if len(column):
            column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
            width = 8192
            for at in range(0, int(column[-1]) + 1, width):
                lo, hi = np.searchsorted(column, (at, at + width))
                block = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
                block[owner[lo:hi], column[lo:hi] - at] = 1
                out += block @ block.T
        return out

    def met_before(self, nodes: list[np.ndarray], node: int) -> np.ndarray:
        """Boolean n x n: pairs that share a node smaller than this one."""
        earlier = np.unique(np.concatenate([x[x < node] for x in nodes]))
        has = np.zeros((len(nodes), len(earlier)), np.float32)
        for k, x in enumerate(nodes):
            has[k, np.searchsorted(earlier, x[x < node])] = 1
        return has @ has.T > 0

    def links(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Boolean n x n: pairs of the two sides that reach the threshold.  A cell on the diagonal has everything on both sides."""
        sizes = np.array([len(s) for s in sets], float)
        both = self.overlaps(sets)
        linked = both * self.den >= self.num * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(linked, False)
        return linked & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))


def _smallest_partner(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Of each member the smallest id that it reaches through links of the cell."""
    low = ids.copy()
    while True:
        near = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        following = np.minimum(low, near)
        if (following == low).all():
            return low
        low = following


def join(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, set_id: one row per document.

    ``class_id`` is the smallest id of the documents that verified links connect, ``n_links`` the number of other documents
    at the threshold or above, ``set_id`` the smallest id with the same shingle set.
    """
    return _judged(documents, threshold, trees, depth, target).select("doc_id", "class_id", "n_links", "set_id")


def _judged(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """The columns of ``join``, with ``first`` (whether it stands for its class) and ``hs`` (hashes of its texts)."""
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"depth must be between 1 and {DEPTH}")
    raw = _signatures(documents, trees)
    signed = cut(raw.groupBy("doc_id", "set_key").agg(F.min(F.struct("h", "n", "paths")).alias("s"), F.collect_set("h").alias("hs")).select("doc_id", "set_key", "s.*", "hs"))
    known = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "h", "n", "paths")).alias("r"), F.count("*").alias("copies")).select("set_key", "copies", "r.*")
    # an id may stand for several sets: v numbers the representatives in the order of their ids
    reps = cut(reps.orderBy("doc_id", "set_key")).withColumn("v", F.monotonically_increasing_id())

    # dealt by v: what a pass over sorted tries leaves of a hot branch stands in few partitions
    buckets = _buckets(cut(_matched(reps, _length(threshold, trees, depth, target)).repartition("v")))
    sizes = buckets.join(reps.select("v", "n"), "v").groupBy("dense", "bucket").agg(F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    sizes = cut(sizes)
    dealt = buckets.join(few(sizes) or sizes, ["dense", "bucket"]).groupBy("v").agg(F.collect_list(F.struct("bucket", "chunks", "dense")).alias("cells"))  # one for each tree at most
    near = cut(dealt.join(reps.select("v", "doc_id", "h", "set_key", "copies"), "v"))

    links = cut(_verified(documents, near, threshold))
    classes = cut(components_by_leaders(links.select("v", F.col("hook").alias("leader"))))
    heads = cut(classes.where("v = label").join(reps.select("v", "doc_id"), "v").select("label", F.col("doc_id").alias("class_id")))  # the smallest number has the smallest id
    classes = classes.join(few(heads) or heads, "label")
    counted = links.groupBy("v").agg(F.sum("links").alias("links"))
    found = reps.select("set_key", "copies", "doc_id", "v").join(counted, "v", "left").join(classes, "v", "left")
    found = found.select("set_key", F.col("doc_id").alias("set_id"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.coalesce("label", "v") == F.col("v")).alias("leads"))
    plain = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"), "hs")
    out = plain.join(found, "set_key", "left")
    first = F.coalesce(F.col("leads") & (F.col("doc_id") == F.col("set_id")), F.lit(True))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("set_id", "doc_id").alias("set_id"), first.alias("first"), "hs")


def _verified(documents: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """v, links, hook of each member of each cell."""
    texts = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).join(near, ["doc_id", "h"])

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RunHashes(BLANKS)
        for b in parts:
            rows, size = [], 0
            for v, text, key, copies, cells, h in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                s = shingles(text or "", hashes)
                if set_key(s) == key:  # unlike texts of an id may share a hash
                    raw = s.tobytes()
                    own = np.array(sorted(c["bucket"] for c in cells if not c["dense"]), np.int64).tobytes()
                    for c in cells:
                        chunk = h % c["chunks"]
                        for other in range(c["chunks"]):
                            rows.append((v, copies, c["dense"], c["bucket"], min(chunk, other), max(chunk, other), chunk, own, raw))
                            size += len(raw)
                            if len(rows) >= 256 or size >= 16 << 20:
                                yield _spread_batch(rows)
                                rows, size = [], 0
            if rows:
                yield _spread_batch(rows)

    cells = map_arrow(texts.select("v", "text", "set_key", "copies", "cells", F.pmod(F.xxhash64("v"), F.lit(1 << 31))), spread, "v long, copies long, dense boolean, bucket long, i int, j int, chunk int, own binary, shingles binary")
    cell = ["dense", "bucket", "i", "j"]
    dealt = cells.repartition(*cell).sortWithinPartitions(*cell, "v")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, current, rows, out = Cell(threshold), None, [], []

        def settle() -> None:
            ids = np.array([r[0] for r in rows], np.int64)
            if len(ids) > 1:
                chunk = np.array([r[2] for r in rows])
                linked = judge.links([np.frombuffer(r[4], np.uint64) for r in rows], chunk == current[2], chunk == current[3])
                counted = linked if current[0] else linked & ~judge.met_before([np.frombuffer(r[3], np.int64) for r in rows], current[1])
                low = _smallest_partner(ids, linked)
                copies = np.array([r[1] for r in rows], np.int64)
                any_link = linked.any(axis=1)
                out.append((ids[any_link], (counted @ copies)[any_link], low[any_link]))

        for b in parts:
            v, copies, dense, bucket, i, j, chunk, own, raw = (b.column(k).to_pylist() for k in range(9))
            for k in range(len(v)):
                if (dense[k], bucket[k], i[k], j[k]) != current:
                    if rows:
                        settle()
                    current, rows = (dense[k], bucket[k], i[k], j[k]), []
                if not rows or rows[-1][0] != v[k]:  # repeated rows of a document stand next to each other
                    rows.append((v[k], copies[k], chunk[k], own[k], raw[k]))
            if sum(len(x[0]) for x in out) > 5000:
                yield _links_batch(out)
                out = []
        if rows:
            settle()
        if out:
            yield _links_batch(out)

    return map_arrow(dealt.select("v", "copies", *cell, "chunk", "own", "shingles"), verify, "v long, links long, hook long")


def _spread_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["v", "copies", "dense", "bucket", "i", "j", "chunk", "own", "shingles"])


def _links_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["v", "links", "hook"])


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, of one document (the smallest id) of each class; rows without an id stay."""
    gone_id, gone_h = free_names(documents, "gone", "gone_h")
    gone = cut(_judged(documents, threshold).where("NOT first").select(F.col("doc_id").alias(gone_id), F.explode("hs").alias(gone_h)))
    same = (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_h))
    return documents.join(gone, same, "left_anti")
