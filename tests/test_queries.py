from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__
from tessera import queries

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def answers(spark, request):
    """Columns and rows of the queries that are tested: several run at a time, as most of a small query's time is planning."""

    def answer(name):
        got = queries.QUERIES[name](spark, SF)
        return got.columns, got.collect()

    names = [i.callspec.params["name"] for i in request.session.items if i.name.startswith("test_query_equals_sql[") and i.path == request.path]
    pool = ThreadPoolExecutor(6)
    yield {n: pool.submit(answer, n) for n in names}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(sql, answers, name):
    columns, rows = answers[name].result()
    want = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == sorted(map(repr, want.fetchall()))


def test_every_query_has_a_twin():
    assert set(queries.QUERIES) == set(queries.ORACLES)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["i", "j", "v"] and df.count() == 64 * 64
