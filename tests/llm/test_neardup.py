import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.common import BLANKS, RunHashes
from tessera.llm.graph import components, components_by_leaders


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    docs = {}
    for i, t in rows:
        docs.setdefault(i, sets(t))
    ids = [i for i in docs if i is not None]
    links = {i: {j for j in ids if j != i and docs[i] and docs[j] and len(docs[i] & docs[j]) >= threshold * len(docs[i] | docs[j])} for i in ids}
    label = {}
    for i in sorted(ids):
        if i not in label:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in label:
                    label[k] = i
                    stack += links[k]
    return {(i, label[i], len(links[i])) for i in ids}


def corpus(seed, groups, size):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, k = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 8, 60, 120]))]
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {(r.doc_id, r.class_id, r.n_links) for r in rows}


@pytest.mark.parametrize("chunk,by_node", [(64, False), (4, False), (64, True), (4, True)])
def test_against_brute_force(spark, monkeypatch, chunk, by_node):
    monkeypatch.setattr(neardup, "CHUNK_ROWS", chunk)  # 4: groups are cut into cells
    if by_node:  # every node is a cell, so pairs meet in many of them
        monkeypatch.setattr(neardup, "_buckets", lambda matched: matched.select("v", F.lit(False).alias("dense"), F.col("node").alias("bucket")))
    rows = corpus(1, 25, 14)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, comp string, n long").repartition(3)
    assert found(neardup.join(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, "w " * 20_000), (10, "w " * 20_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(neardup.join(df)) == brute(rows)
    with_null = spark.createDataFrame([*rows, (None, "a b c d e")], "doc_id long, text string")
    got = neardup.join(with_null).where("doc_id IS NULL").collect()
    assert [(r.class_id, r.n_links) for r in got] == [(None, 0)]
    assert neardup.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one(spark):
    rows = [*corpus(2, 6, 5), (None, "a b c"), (900, None)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, gone string").withColumn("GONE_H", F.lit(1))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    want = {i for i, c, _ in brute(rows) if i == c} | {None}
    assert {r.doc_id for r in kept.collect()} == want


def test_prefixes_shorten_to_the_target_recall():
    alike, apart = np.array([0.95]), np.array([0.8])
    d = neardup.matched_length(apart, np.ones(1), 32, 8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 32
    assert neardup.matched_length(alike, np.ones(1), 32, 8, 0.9999) == 8  # very similar pairs need no shortening
    assert neardup.matched_length(np.array([0.95, 0.8]), np.array([10, 1]), 32, 8, 0.9999) == 7
    assert neardup.matched_length(apart, np.ones(1), 1, 8, 0.9999) == 1


def _symbols(paths):
    return np.stack([(paths.view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFF) for shift in (48, 32, 16, 0)], axis=2).reshape(len(paths), 8)


def test_paths_agree_with_jaccard():
    hashes, signer = RunHashes(BLANKS), neardup.Signer(200)
    w = [f"w{k}" for k in range(300)]
    a, b = neardup.shingles(" ".join(w), hashes), neardup.shingles(" ".join(w[:150] + ["zz"] + w[151:]), hashes)
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = _symbols(signer.paths(a)) == _symbols(signer.paths(b))
    assert abs(same.mean() - j) < 0.03
    for n in (2, 4):
        assert abs(same[:, :n].all(axis=1).mean() - j**n) < 0.12


@pytest.mark.parametrize("length,partitions,batch", [(6, 7, 10_000), (3, 2, 3), (8, 1, 1), (1, 5, 2)])
def test_sorted_tries_hold_what_grouping_by_prefix_gives(spark, length, partitions, batch):
    r = random.Random(length)
    paths = [[[r.randrange(2) for _ in range(8)] for _ in range(3)] for _ in range(120)]
    pack = lambda s: int(np.array([sum(x << (48 - 16 * k) for k, x in enumerate(s))], np.uint64).view(np.int64)[0])
    reps = spark.createDataFrame([(v, [(pack([x * 40_000 for x in p[:4]]), pack(p[4:])) for p in ps]) for v, ps in enumerate(paths)], "v long, paths array<struct<hi:long,lo:long>>")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before, common_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), neardup.map_arrow.__globals__["BATCH_ROWS"]
    neardup.map_arrow.__globals__["BATCH_ROWS"] = batch
    try:
        rows = neardup._matched(reps, length).collect()
    finally:
        neardup.map_arrow.__globals__["BATCH_ROWS"] = common_rows
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == len(set(rows))
    got = {}
    for row in rows:
        got.setdefault(row.node, set()).add(row.v)
    want = {}
    for v, ps in enumerate(paths):
        for t, p in enumerate(ps):
            want.setdefault((t, *p[:length]), set()).add(v)
    many = lambda groups: sorted(sorted(x) for x in groups.values() if len(x) > 1)
    assert many(got) == many(want)


def test_chains_of_unlike_documents_are_compared_by_node(spark):
    """A chain is one component, of a million pairs here; as many are compared as collide.  A group that meets everywhere is a cell."""
    chain = [(1000 + k, v) for k in range(999) for v in (k, k + 1)]
    group = [(5000 + t, 2000 + v) for t in range(20) for v in range(12) if (v + t) % 7]
    got = neardup._buckets(spark.createDataFrame(chain + group, "node long, v long")).collect()
    sizes = {}
    for r in got:
        sizes[r.dense, r.bucket] = sizes.get((r.dense, r.bucket), 0) + 1
    assert sum(n * n for (dense, _), n in sizes.items() if not dense) == 4 * 999
    assert [n for (dense, _), n in sizes.items() if dense] == [12]


def test_recall_on_the_documents_table(spark):
    """All pairs at the threshold, found through an index of shingles, against what the join counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, sets(r.text)) for r in docs.select("doc_id", "text").collect()]
    where, links = {}, dict.fromkeys((i for i, _ in rows), 0)
    for k, (_, s) in enumerate(rows):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(rows):
        shared = {}
        for x in s:
            for other in where[x]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if n >= 0.8 * (len(s) + len(rows[other][1]) - n):
                links[i] += 1
                links[rows[other][0]] += 1
    got = {r.doc_id: r.n_links for r in neardup.join(docs).collect()}
    assert sum(links.values()) > 0 and all(got[i] <= n for i, n in links.items())
    assert sum(got.values()) >= 0.99 * sum(links.values())


def test_shingles_follow_words(spark):
    hashes = RunHashes(BLANKS)
    assert len(neardup.shingles("a b c d e f", hashes)) == 2
    assert (neardup.shingles("A  b\nc d\te", hashes) == neardup.shingles("a b c d e", hashes)).all()
    texts = [" ".join(f"{k * j % 97}q{j}" for j in range(60)) for k in range(40)]
    assert len({x for t in texts for x in neardup.shingles(t, hashes).tolist()}) == len(set().union(*map(sets, texts)))


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, 700), (700, 600), (8, 8)]
    label = {}
    graph = {}
    for a, b in edges:
        if a != b:
            graph.setdefault(a, set()).add(b)
            graph.setdefault(b, set()).add(a)
    for v in sorted(graph):
        stack = [v]
        while stack:
            k = stack.pop()
            if k not in label:
                label[k] = v
                stack += graph[k]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(x) for x in components(df).collect()} == set(label.items())
    led = spark.createDataFrame([(v, w) for v in graph for w in [*graph[v], v]], "v long, leader long")
    assert {tuple(x) for x in components_by_leaders(led).collect()} == set(label.items())


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (2, None), (3, b), (3, c), (3, c + " more"), (None, a), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.join(df).collect() if r.doc_id is not None)
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 0), (2, 2, 1), (3, 2, 1), (3, 3, 1), (3, 3, 1)]
    kept = [tuple(r) for r in neardup.keep_one(df).collect()]
    assert len(kept) == 6 and {(1, a), (2, b), (2, None), (None, a), (None, "")} < set(kept)
    assert sum(r in kept for r in [(3, c), (3, c + " more")]) == 1


def test_links_at_the_threshold_are_found_among_many_closer_ones(spark):
    """Groups of very near copies hold most links; the pairs at 0.8 are all found nevertheless."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for k in range(2000):
        w = [word() for _ in range(13)]  # nine shingles, of which the pair shares eight
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:12], word()]))]
    assert all(10 * len(sets(a) & sets(b)) == 8 * len(sets(a) | sets(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    for g in range(40):
        w = [word() for _ in range(300)]
        rows += [(100_000 + 1000 * g + k, " ".join([*w, word()])) for k in range(60)]  # any two differ in their last shingle
    got = {x.doc_id: x.n_links for x in neardup.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [i for i, _ in rows if got[i] != (1 if i < 100_000 else 59)] == []
