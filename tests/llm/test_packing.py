import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzAÉéßΣσς.,'!?12 \n\t\x1ćİıſǅK<|endoftext>日 ")), max_size=40))
def test_words_encode_as_whole_texts_do(text):
    cache, tokenizer = packing._cache(PATH), Tokenizer.from_file(PATH)
    assert cache.by_word
    assert cache.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = packing.WordCache(path)
    assert not cache.by_word
    text = "  Two  blanks,\nand lines "
    assert np.frombuffer(cache.ids(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing.WordCache, "most", 50)
    cache = packing.WordCache(PATH)
    texts = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(400)]
    tokenizer = Tokenizer.from_file(PATH)
    for t in texts + texts[::-1]:
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(cache) <= 51 and len(cache.older) <= 51


def check(pieces, documents, window, tokenizer):
    """Every id of every document in one piece, sequences gapless and full but for the last."""
    whole = {}
    for i, t in documents:
        whole.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    assert sum(p.length for p in pieces) == sum(len(x) for v in whole.values() for x in v)
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert any(p.doc_tokens == len(x) and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in whole[p.doc_id])
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, rows in by_seq.items():
        at = 0
        for off, n in sorted(rows):
            assert off == at
            at += n
        assert at == window if k < len(by_seq) - 1 else at <= window
    return by_seq


def test_pieces_cover_everything_once(spark, tokenizer):
    r = random.Random(5)
    docs = [(k, " ".join(r.choice(["alpha", "Beta,", "gamma.", "x1"]) for _ in range(r.choice([0, 1, 3, 40, 700])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "long " * 3000), (None, "no id")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, ids string, n long").repartition(5)
    pieces = packing.pack(df, PATH, window=64).collect()
    last = max(check(pieces, docs, 64, tokenizer).items())[1]
    length = sum(n for _, n in last)
    assert all(p.sequence_length == (length if p.sequence_id == max(q.sequence_id for q in pieces) else 64) for p in pieces)


def test_last_sequence_is_not_padded_at_a_power_of_two(spark):
    for texts, padded in ((["a"] * 2, 4), (["a"] * 3, 16)):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        assert {p.padded_length for p in packing.pack(df, PATH, window=16).collect()} == {padded}


def test_empty_and_repeated_rows(spark, tokenizer):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    rows = [(1, "same text")] * 3
    check(packing.pack(spark.createDataFrame(rows, schema), PATH, window=4).collect(), rows, 4, tokenizer)


def test_the_documents_table_is_packed_whole(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()], packing.WINDOW, tokenizer)
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    assert sorted(sizes.values())[1:] == [packing.WINDOW] * (len(sizes) - 1)  # all but one are full
