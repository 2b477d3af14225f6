"""Null and validity queries read the whole, unchanged tables; injected versions grow with the table."""

import duckdb
import pytest

import __spark_entry__ as E

INF, NAN = float("inf"), float("nan")


@pytest.fixture
def tables(spark, tmp_path):
    def make(docs, vecs):
        folder = str(tmp_path / f"t{len(docs)}")
        spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>, label int").write.parquet(
            f"{folder}/embeddings.parquet")
        return folder
    return make


def both(spark, folder, name):
    """The query's rows, after comparing them with its SQL's."""
    got = sorted(tuple(r) for r in E.queries()[name](spark, folder).collect())
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(E.oracle_sql()[name]).fetchall())
    return got


def test_long_texts_and_real_nulls(spark, tables):
    vecs = [(1, [0.5, INF, -0.5], 0)]
    docs = [(i, "x" * (30_000 if i == 3 else i)) for i in range(1, 11)]
    folder = tables(docs, vecs)
    assert both(spark, folder, "null_stop_whole") == [(i, len(t)) for i, t in docs]
    assert both(spark, folder, "null_skip_whole") == [(10, 10, 30_052, 30_052)]
    docs = [*docs, (11, None), (12, "y")]
    folder = tables(docs, vecs)
    assert both(spark, folder, "null_stop_whole") == [(i, len(t)) for i, t in docs[:10]]
    assert both(spark, folder, "null_skip_whole") == [(11, 11, 30_053, 30_053)]


def test_first_injected_null_moves(spark, tables):
    for n, first in ((40, 35), (400, 301)):
        folder = tables([(i, "x") for i in range(n + 1)], [(1, [0.5], 0)])
        assert len(both(spark, folder, "null_stop_injected")) == first
        assert both(spark, folder, "null_skip_injected")[0][0] == n + 1 - len(range(first, n + 1, 7))


def test_real_infinity_is_not_nan(spark, tables):
    folder = tables([(1, "x")], [(1, [0.5, INF, -0.5], 0), (2, [NAN, -INF, INF], 0), (3, [0.9, -0.9], 1),
                                 (89, [0.1, NAN, INF], 2), (96, [0.1, 0.2, INF], 2)])
    assert both(spark, folder, "vector_validity_whole") == [(0, 2, 1, 3), (1, 1, 0, 0), (2, 2, 1, 2)]
    assert both(spark, folder, "vector_validity_injected") == [(0, 2, 1, 3), (1, 1, 0, 0), (2, 2, 2, 3)]
