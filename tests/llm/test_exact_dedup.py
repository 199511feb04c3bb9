import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, queries

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Ab É", 9), (2, "aB É", 8), (3, "ab é", 7), (4, None, 6), (5, "", 5), (6, "x" * 200_000, 4), (7, "X" * 200_000, 3), (7, "x" * 200_000, 2), (8, "Straße", 1), (9, "STRASSE", 0), (None, "Ab é", 0)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, h long").withColumnRenamed("h", "n_rows")  # a clashing extra column


def brute(rows, keep):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(A_Z), []).append(i)
    out = set()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out |= {(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    return out


def found(df):
    rows = df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.fixture(params=[None, 0], ids=["broadcast", "shuffled"])
def most(request, monkeypatch):
    if request.param is not None:
        monkeypatch.setattr(common, "BROADCAST_ROWS", request.param)


def test_against_brute_force(spark, most):
    for keep in ("largest", "smallest"):
        assert found(exact_dedup.groups(table(spark), keep)) == brute(ROWS, keep)


def test_collisions_of_the_hash_are_told_apart(spark, most):
    for parts in (1, 2):
        by_length = lambda t, n=parts: F.unhex(F.lpad((F.length(t) % n).cast("string"), 2, "0"))
        assert found(exact_dedup.groups(table(spark), "largest", hash_of=by_length)) == brute(ROWS, "largest")


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark, most):
    df = table(spark, [*ROWS, ROWS[0]]).withColumns({"_id": F.lit("K1"), "OWN_SHA": F.lit("s"), "found_id": F.lit(5), "h": F.lit(1)})
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert {tuple(r)[3:] for r in rows} == {("K1", "s", 5, 1)}
    assert sorted((r[0] if r[0] is not None else -1, len(r[1] or "")) for r in rows) == [(1, 4), (3, 4), (4, 0), (6, 200_000), (8, 6), (9, 7)]


def test_texts_of_an_id_that_differ_in_case_beyond_ascii_stay_apart(spark, most):
    rows = [(7, "É x", 0), (7, "é x", 1), (8, "É X", 2), (8, "e x", 3), (9, "é x", 4), (9, "é X", 5), (10, "plain", 6)]
    df = table(spark, rows)
    assert found(exact_dedup.groups(df)) == brute(rows, "smallest")
    assert sorted(r[0] for r in exact_dedup.keep_one(df).collect()) == [7, 7, 8, 10]
    assert sorted(r[0] for r in exact_dedup.keep_one(df, "largest").collect()) == [8, 8, 9, 10]


def test_empty_table(spark):
    assert found(exact_dedup.groups(table(spark, []), "largest")) == set()
    assert exact_dedup.keep_one(table(spark, [])).collect() == []


def test_the_query_gives_a_row_per_row_as_its_sql_does(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ab"), (1, "Ab"), (1, "aB"), (2, "ab"), (None, "x"), (None, "x"), (3, None)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op9_exact_dedup(spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(queries.ORACLES["op9_exact_dedup"]).fetchall()
    assert len(got) == 7 and sorted(map(str, got)) == sorted(map(str, want))
