import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.ngram_model import Featurizer, fit_ftrl

SCHEMA = "doc_id long, text string, score string, keep int"


def corpus(n=900, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = ["".join(r.choice("abcdeilmnorst") for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 120))]
        kind = r.choice(["good", "good", "good", "signs", "loop", "toxic"])
        if kind == "signs":
            w = [x + r.choice(["%%%", "***"]) for x in w]
        if kind == "loop":
            w = [w[0]] * len(w)
        if kind == "toxic":
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["badword", "worseword", "worstword"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(kind in ("good", "toxic")), int(kind == "toxic")))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(3).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), dict(rows), {x[0]: x[1:] for x in labels}


def test_held_out_accuracy(tables):
    docs, labels, _, truth = tables
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [(r.predicted, truth[r.doc_id][0]) for r in got if r.held_out]
    assert len(unseen) > 100 and sum(a == b for a, b in unseen) >= 0.97 * len(unseen)


def test_held_out_labels_are_never_learned_from(tables):
    docs, labels, _, _ = tables
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, labels).weights == quality.fit(docs, wrong).weights).all()


def test_the_sample_is_bounded(tables):
    docs, labels, _, _ = tables
    assert len(quality.labelled_sample(docs, labels, ["quality"], max_rows=50)) == 50
    some = quality.labelled_sample(docs, labels, ["quality"], max_rows=500, max_chars=3000)
    assert sum(len(t) for t, _ in some) <= 3000 and len(some) > 3


def test_keep_good_keeps_rows_whole(tables):
    docs, labels, _, truth = tables
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth[i][0] for i in ids) >= 0.99 * sum(t[0] for t in truth.values())
    assert sum(1 - truth[i][0] for i in ids) <= 0.05 * len(ids)


def test_odd_rows(spark, tables):
    docs, labels, _, _ = tables
    model = quality.fit(docs, labels)
    rows = [(1, None), (2, ""), (None, "words"), (3, "word " * 60_000), (3, "word " * 60_000)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == 5 and got[0].score == got[1].score and not got[2].held_out and got[3] == got[4]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, model).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.labelled_sample(docs, nulls, ["quality"]) == []


def test_scores_are_sparse_dot_products():
    f = Featurizer(12)
    x = f.transform(["a b a b c", "", "%%% !! a"])
    model = fit_ftrl(x, np.array([1.0, 0, 0]), 12, l1=0.01)
    dense = np.zeros((3, 1 << 12))
    for i in range(3):
        dense[i, x.buckets[x.starts[i] : x.starts[i + 1]]] = x.values[x.starts[i] : x.starts[i + 1]]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(dense @ model.weights + model.bias))))


def test_rates_match_the_targets(tables):
    docs, labels, _, truth = tables
    rows = mixing.rates(docs, labels).collect()
    assert len(rows) == len(truth) and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    totals = np.array([sum(r.tokens * r.rate * r[p] for r in rows) for p in ("p_clean", "p_low", "p_toxic")])
    have = sum(r.tokens * r.p_clean for r in rows)
    target = have / mixing.WEIGHTS[0] * np.array(mixing.WEIGHTS)
    assert abs(totals - target).max() <= 0.05 * have
    clean = [r for r in rows if truth[r.doc_id] == (1, 0)]
    toxic = [r for r in rows if truth[r.doc_id][1] == 1]
    assert np.mean([r.copies >= 1 for r in clean]) > 0.97 and np.mean([r.copies for r in toxic]) < 0.15


def test_rates_are_what_plain_projected_gradient_gives(tables):
    docs, labels, _, _ = tables
    scored = mixing.with_posteriors(docs.select("doc_id", "text"), mixing.fit_domains(docs, labels)).cache()
    weights = (0.6, 0.1, 0.3)
    fitted = mixing.fit_rates(scored, weights)
    got = {r.doc_id: r.rate for r in scored.select("doc_id", fitted.column().alias("rate")).collect()}
    rows = scored.collect()
    p, tok = np.array([[r._mix_p0, r._mix_p1, r._mix_p2] for r in rows]), np.array([r._mix_tokens for r in rows], float)
    have = tok @ p
    target = have[0] / 0.6 * np.array(weights)
    rate, steps = np.ones(len(rows)), 0
    while steps < mixing.STEPS and abs((tok * rate) @ p - target).max() > mixing.TOLERANCE * target.sum():
        rate = np.maximum(0, rate - fitted.step * (p @ (((tok * rate) @ p - target) / have)))
        steps += 1
    assert steps == len(fitted.history)
    assert max(abs(got[r.doc_id] - x) for r, x in zip(rows, rate, strict=True)) < 1e-6
    assert abs((tok * rate) @ p - target).max() <= 0.01 * target.sum()


def test_mix_repeats_and_drops_rows(spark, tables):
    docs, labels, _, _ = tables
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.rates(docs, labels).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}
    with pytest.raises(ValueError):
        mixing.rates(docs, labels, (0, 1, 1))


def test_mixing_odd_tables(spark, tables):
    docs, labels, _, _ = tables
    schema = "doc_id long, text string"
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b c"), (3, "word " * 40_000)], schema)
    assert len(mixing.rates(odd, labels).collect()) == 5
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.p_clean, r.copies) for r in mixing.rates(odd, none).collect()} == {(1.0, 1)}
    assert mixing.rates(spark.createDataFrame([], schema), labels).collect() == []
    assert mixing.mix(spark.createDataFrame([], schema), labels).collect() == []


def test_emitted_copies_meet_the_target_of_each_domain(spark):
    rows, labels = corpus(9000, 5)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.rates(docs, labels).collect()
    p, tok = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in got]), np.array([r.tokens for r in got], float)
    target = tok @ p[:, 0] / mixing.WEIGHTS[0] * np.array(mixing.WEIGHTS)
    rate, copies = np.array([r.rate for r in got]), np.array([r.copies for r in got])
    assert (abs((tok * rate) @ p - target) <= 2e-3 * target).all()  # of its own target
    part = rate - np.floor(rate)
    spread = np.sqrt((part * (1 - part) * tok**2) @ p**2)
    assert (abs((tok * copies) @ p - target) <= 2e-3 * target + 3 * spread).all() and (3 * spread < 0.7 * target).all()  # losing a domain fails
    assert ((np.floor(rate) <= copies) & (copies <= np.ceil(rate))).all()


def test_copies_are_drawn_without_bias(spark):
    some = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.col("id").alias("_mix_tokens"), *[F.lit(0.5).alias(c) for c in mixing._P])
    for rate in (0.03, 0.1, 0.8, 1.2, 2.0):
        mean = some.agg(F.avg(mixing._copies(F.lit(rate), F.col("doc_id")))).first()[0]
        assert abs(mean - rate) < 0.015


def test_a_text_beyond_the_bound_is_passed_over(spark, tables):
    docs, labels, _, _ = tables
    first = quality.labelled_sample(docs, labels, ["quality"], max_rows=1)[0][0]
    huge = docs.withColumn("text", F.when(F.col("text") == first, F.repeat(F.lit("word "), 100_000)).otherwise(F.col("text")))
    some = quality.labelled_sample(huge, labels, ["quality"], max_rows=50, max_chars=100_000)
    assert len(some) == 49 and sum(len(t) for t, _ in some) <= 100_000


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k * 1000, f"text {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    rows = quality.labelled_sample(docs, labels, ["quality"])
    assert len(rows) == sum(zlib.crc32(str(k * 1000).encode()) % 5 != 0 for k in range(300)) > 200
    assert len(quality.labelled_sample(docs, labels, ["quality"], max_rows=100)) == 100


def test_labels_that_repeat_an_id_count_as_the_largest(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0)], "doc_id long, quality int")
    want = [("b", 1), ("c", 0)]
    assert sorted(quality.labelled_sample(docs, labels, ["quality"])) == [w for w, i in zip(want, (1, 2), strict=True) if zlib.crc32(str(i).encode()) % 5]


def test_mix_keeps_columns_of_any_name(spark, tables):
    docs, labels, _, _ = tables
    odd = docs.withColumns({"_mix_tokens": F.lit("t"), "_mix_p0": F.lit(1), "c0": F.lit(2), "_mix_copy": F.lit("y")})
    mixed = mixing.mix(odd, labels)
    assert mixed.columns == odd.columns
    assert {tuple(r) for r in mixed.select("_mix_tokens", "_mix_p0", "c0", "_mix_copy").collect()} == {("t", 1, 2, "y")}
    assert mixed.count() == mixing.mix(docs, labels).count()


def test_the_documents_table_meets_its_targets(spark):
    """Expected tokens within a thousandth of the budget, emitted ones within the error of drawing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.rates(docs, labels).collect()
    p, tok = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in got]), np.array([r.tokens for r in got], float)
    target = tok @ p[:, 0] / mixing.WEIGHTS[0] * np.array(mixing.WEIGHTS)
    rate, copies = np.array([r.rate for r in got]), np.array([r.copies for r in got])
    assert (abs((tok * rate) @ p - target) <= 1e-3 * target.sum()).all() and (abs((tok * rate) @ p - target) <= 2e-3 * target).all()
    part = rate - np.floor(rate)
    assert (abs((tok * copies) @ p - target) <= 1e-3 * target.sum() + 4 * np.sqrt((part * (1 - part) * tok**2) @ p**2)).all()


def test_the_pipeline_learns_from_all_labelled_rows(spark, tmp_path):
    """Bad and toxic documents lie beyond the first 12,000 labelled rows by hash, where a bounded sample doesn't see them."""
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("at"))
    last = ids.where(~quality.held_out(F.col("doc_id"))).orderBy("at").limit(quality.MAX_ROWS).agg(F.max("at")).first()[0]
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(50)))
    late = F.col("at") > last
    rows = ids.select("doc_id", late.alias("late"), F.concat_ws(" ", word(1), word(2), word(3), F.when(late, F.lit("marked"))).alias("text"))
    docs = rows.repartition(4).cache()
    assert 2000 < docs.where("late").count() < 8000
    for name, quality_of, toxic_of in (("bad", "IF(late, 0, 1)", "0"), ("toxic", "1", "IF(late, 1, 0)")):
        docs.selectExpr("doc_id", f"{quality_of} AS quality", f"{toxic_of} AS toxic").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept = {r.late: r["count"] for r in corpus_pipeline.quality_filter(spark, docs, f"{tmp_path}/bad").groupBy("late").count().collect()}
    assert kept == {False: docs.where("NOT late").count()}
    mixed = {r.late: r["count"] for r in corpus_pipeline.mixture(spark, docs, f"{tmp_path}/toxic").groupBy("late").count().collect()}
    assert mixed.get(True, 0) < 0.1 * docs.where("late").count() and mixed[False] > 0.9 * docs.where("NOT late").count()


def test_models_of_shards(spark, tables):
    docs, labels, _, truth = tables
    alone = quality.fit_shards(docs, labels, ["quality"], 1, lambda: Featurizer(quality.BITS), lambda y: [y[:, 0].astype(float)], quality.BITS)[0]
    whole = quality.fit(docs, labels)
    assert np.allclose(alone.weights, whole.weights, atol=1e-6) and abs(alone.bias - whole.bias) < 1e-9
    assert (quality.fit_all(docs, labels).weights == whole.weights).all()
    models = [quality.fit_all(d, labels, max_rows=200) for d in (docs, docs.union(docs.withColumn("text", F.lit(None))).repartition(5))]
    assert quality.shards_of(docs, labels, ["quality"], max_rows=200) == 4
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    got = quality.score(docs, models[0]).where("held_out").collect()
    assert sum(r.predicted == truth[r.doc_id][0] for r in got) >= 0.95 * len(got)
    domains, every = mixing.fit_all_domains(docs, labels), mixing.fit_domains(docs, labels)
    assert domains.biases == every.biases and all((a == b).all() for a, b in zip(domains.weights, every.weights, strict=True))
