import math

import numpy as np

from tessera.llm import topk


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        best = {}
        for i, v in good:
            if i != q:
                s = max((sum(a * b for a, b in zip(u, v)) for j, u in good if j == q and len(u) == len(v)), default=None)
                if s is not None:
                    best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, r, i, s))
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0, "s") for i, v in rows], "vec_id long, embedding array<float>, score int, q string").repartition(3)
    got = topk.search(df, **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=20) / 4).tolist()) for k in range(160)]
    rows += [(k, rows[3][1]) for k in range(160, 190)]  # ties go to the smaller id
    rows += [(50, rows[7][1]), (200, None), (250, [float("nan")] * 20), (300, [None] + [0.1] * 19), (350, []), (400, [0.5] * 7), (401, [0.25] * 7), (None, rows[0][1]), (450, [float("inf")] * 20)]
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "GROUP_ROWS", 2)
    assert found(spark, rows, every=20) == brute(rows, 20)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, -1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, []) == set()


def test_bounds_prune_without_losing_anything():
    rng = np.random.default_rng(2)
    block = rng.integers(-5, 6, (3000, 64))
    block[:10] *= 40  # a few long vectors
    queries = np.vstack([block[:10], rng.integers(-5, 6, (3, 64))])
    ids = np.arange(len(block))
    best = topk.Best(len(queries), 5)
    taken = sum(topk.search_block(queries, np.full(len(queries), -1), block[k : k + 500], ids[k : k + 500], best) for k in range(0, 3000, 500))
    for i, q in enumerate(queries):
        s = block @ q
        order = np.lexsort((ids, -s))[:5]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == s[order].tolist()
    assert taken < 0.8 * block.size * len(queries)
