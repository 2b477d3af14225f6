import corpus_pipeline as P
from tests.llm import cases


def test_language_stage_without_labels(spark):
    rows = [(i, t, None, s) for i, t, _, s in cases.awkward_rows()]
    out = dict(P.STAGES)["language_id"](spark, cases.table(spark, rows), "")
    want = sorted(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert sorted(r["doc_id"] for r in out.collect()) == want and len(want) > 20
