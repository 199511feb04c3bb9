"""The pipeline against plain Python over the same fitted models."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.ngram_model import Featurizer
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check
from tests.llm.test_quality_and_mixing import corpus


def test_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows, labels = corpus(300, 7)
    for k in range(60):  # exact and near copies
        i, t = r.choice(rows)
        w = t.split()
        if k % 2:
            w[r.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w) if k % 2 else t.upper() if k % 3 else t))
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = lambda ids: docs.where(docs.doc_id.isin(ids))
    known = spark.read.parquet(f"{tmp_path}/labels.parquet")
    text = dict(rows)

    model = quality.fit(docs, known)
    kept = [i for i, s in zip(text, model.score(Featurizer(quality.BITS).transform([t or "" for t in text.values()])), strict=True) if s >= 0.3]
    a_z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    for i in sorted(kept):
        first.setdefault((text[i] or "").translate(a_z), i)
    single = sorted(first.values())
    near = sorted(i for i, c, _ in brute([(i, text[i]) for i in single]) if i == c)
    copies = {x.doc_id: x.copies for x in mixing.rates(table(near), known).collect()}
    mixed = [(i, text[i]) for i in near for _ in range(copies[i])]
    assert len(text) > len(kept) > len(single) > len(near) > len({i for i, _ in mixed})

    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (kept, single, near, [i for i, _ in mixed]), strict=True):
        out = stage(spark, docs_now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(x.doc_id for x in docs_now.collect()) == sorted(want), name
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check(pieces, mixed, 4096, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = "doc_id long, text string, lang string, source string, n_chars long, h string, label int, copies int, class_id int, _gone int, _k_h int"
    for rows in ([], [(1, None, None, None, None, "x", 1, 1, 1, 1, 1), (None, "some words", None, None, 1, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, odd)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_entry_has_all_queries():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert np.all([callable(f) for f in entry.queries().values()])
