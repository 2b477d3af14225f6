"""The pipeline copies no whole rows but those whose id is null or repeated, and keeps one stage's table."""

from pathlib import Path

import corpus_pipeline as P
from glyphmill.llm.common import own_ids, save
from glyphmill.session import checkpoint_dir
from tests.llm import cases


def tables(spark):
    return set(Path(checkpoint_dir(spark).removeprefix("file:")).glob("glyphmill-*/*"))


def copied(spark, new):
    """Rows of the scratch tables ``new`` that hold a whole document."""
    read = [spark.read.parquet(str(p)) for p in new]
    return sum(t.count() for t in read if "_row" in t.columns or "text" in t.columns)


def test_rows_of_own_ids_are_not_copied(spark):
    rows = [(i, f"w{i} " * (20 + i % 9), "en", ("a", "b")[i % 4 == 0]) for i in range(400)]
    odd = [(None, "one text"), (None, "one text"), (7, "more text"), (9, "text yet")]
    for more, most in (([], 0), ([(i, t, "en", "a") for i, t in odd], 8)):
        docs = save(cases.table(spark, rows + more), "docs")
        for name in ("exact_dedup", "near_dedup", "mixing"):
            before = tables(spark)
            out = dict(P.STAGES)[name](spark, docs, "")
            assert copied(spark, tables(spark) - before) <= most, name
            assert out.columns == docs.columns


def test_ids_are_own_and_stay(spark):
    rows = [(i, f"text {i}", "en", "s") for i in range(50)] + [(None, f"null {i}", "en", "s") for i in range(5)] + [
        (i, f"again {i}", "en", "s") for i in range(3)]
    got = own_ids(save(cases.table(spark, rows), "docs")).select("_id", "_row.doc_id", "_row.text")
    first, again = ({r["text"]: (r["_id"], r["doc_id"]) for r in x.collect()} for x in (got, got.repartition(3)))
    assert first == again and len(first) == len(rows) == len({i for i, _ in first.values()})
    for i, text, _, _ in rows:
        own = i is not None and i >= 3
        assert first[text][1] == i and (first[text][0] == i if own else first[text][0] >= 50)


def test_run_keeps_one_stages_table(spark, tmp_path):
    cases.table(spark, cases.awkward_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    before = tables(spark)
    out = P.run(spark, str(tmp_path))
    assert {p.name for p in tables(spark) - before if p.name.startswith("pipeline-")} == {"pipeline-mixing"}
    assert out.count() > 0
