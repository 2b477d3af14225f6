"""Stages with Python workers hand them batches of bounded bytes, however long the texts are."""

import pyarrow as pa
import pytest

import corpus_pipeline as P
from glyphmill.llm.common import save
from glyphmill.session import BATCH_BYTES
from tests.llm import cases

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT = 1 << 16


@pytest.fixture
def unbounded(spark):
    before = spark.conf.getAll.get(KEY)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def largest(spark):
    """(bytes of the largest batch, rows) of 12 MB of text in one partition."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["b", "n"])

    texts = spark.range(0, 3 * BATCH_BYTES // TEXT, 1, 1).selectExpr("id", f"repeat('x', {TEXT}) AS text")
    got = texts.mapInArrow(sizes, "b long, n long").collect()
    return max(r["b"] for r in got), sum(r["n"] for r in got)


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "packing"])
def test_batches_are_bounded_by_bytes(unbounded, name):
    docs = save(cases.table(unbounded, [(i, f"w{i} text", "en", "s") for i in range(20)]), "docs")
    out = dict(P.STAGES)[name](unbounded, docs, "")
    most, rows = largest(unbounded)
    assert most <= BATCH_BYTES + 2 * TEXT and rows == 3 * BATCH_BYTES // TEXT
    assert out.count() > 0


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(KEY, "1000000")
    docs = save(cases.table(unbounded, [(1, "a text", "en", "s")]), "docs")
    P.language_stage(unbounded, docs, "")
    assert unbounded.conf.get(KEY) == "1000000"
