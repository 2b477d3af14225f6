"""n-sequence counts of documents: counted in the row, also with repeated and null ids."""

import pytest

from glyphmill.operators import nseq


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_row_counts_equal_grouped_counts(spark, repeated, n):
    rows = [(1, "the cat, the hat 11 11"), (2, "a\0a\0a\0"), (3, "x"), (4, ""), (5, None), (None, "ééé😀😀😀 "), (6, "abcabc" * 30)]
    if repeated:
        rows += [(1, "the end"), (None, "é é"), (7, "aaaa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least, legal in ((2, True), (1, True), (2, False)):
        got = nseq.nseq_counts(docs, n, "doc", least, legal)
        want = nseq._grouped_counts(docs, ["doc_id"], n, least, legal)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_unique_documents_shuffle_no_windows(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "abab")], "doc_id bigint, text string")
    plan = nseq.nseq_counts(docs, 2, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
