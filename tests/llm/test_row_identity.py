"""Rows with repeated and null ids: one row in, one row out, and one row of a group stays."""

import __spark_entry__ as entry
import corpus_pipeline as P
from glyphmill.llm import exact_dedup
from glyphmill.llm.common import save
from tests.llm import cases

A, B, C = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
NEAR = A + " more"
ROWS = [(1, A), (1, A), (None, A), (None, A), (None, A), (2, A + " "), (None, B), (None, B), (None, C), (3, C), (4, "lone"),
        (None, "lost"), (None, "left")]


def wide(rows):
    return [(i, t, "en", "s") for i, t in rows]


def test_exact_counts_rows(spark):
    got = exact_dedup.exact_dedup(cases.table(spark, wide(ROWS)), digest=True).collect()
    sha = [cases.sha("".join(cases.words(t)).encode()) for _, t in ROWS]
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in got) == sorted((str(r[0]), s) for r, s in zip(ROWS, sha, strict=True))
    for s in set(sha):
        group = [r for r in got if r["text_sha256"] == s]
        assert {r["group_size"] for r in group} == {len(group)} == {sha.count(s)}
        kept = [r for r in group if r["kept"]]
        assert len(kept) == 1 and {r["keep_id"] for r in group} == {kept[0]["doc_id"]}
    assert [r["doc_id"] for r in got if r["kept"] and r["text_sha256"] == sha[0]] == [2]  # the longest


def test_query_counts_rows(spark, tmp_path):
    cases.table(spark, wide(ROWS)).write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()["op4_exact_dedup"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert out.count() == len(ROWS) and out.filter("kept").count() == 6


def test_stages_keep_one_row(spark):
    stages = dict(P.STAGES)
    docs = cases.table(spark, wide([*ROWS, (5, NEAR), (5, NEAR + " yet"), (None, NEAR + " still"), (7, B + " too")]))
    now = save(stages["exact_dedup"](spark, docs, ""), "exact")
    assert now.columns == docs.columns
    texts = [r["text"] for r in now.collect()]
    assert sorted(texts) == sorted([A + " ", B, C, "lone", "lost", "left", NEAR, NEAR + " yet", NEAR + " still", B + " too"])
    now = stages["near_dedup"](spark, now, "")
    assert now.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in now.collect()}
    assert len(got) == 6 and got >= {(2, A + " "), (7, B + " too"), (4, "lone"), (None, "lost"), (None, "left")}
