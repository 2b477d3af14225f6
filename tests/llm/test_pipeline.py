from collections import Counter

import corpus_pipeline as P
from glyphmill.llm.common import save
from tests.llm import cases


def test_stages_against_brute_force(spark):
    rows = cases.awkward_rows()
    docs = cases.table(spark, rows)
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]

    def step(name, df):
        out = save(stages[name](spark, df, ""), name)
        assert out.columns == docs.columns
        return out

    now = step("language_id", docs)
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(r[0] for r in rows)
    now = step("exact_dedup", now)
    keep = cases.exact(rows)
    rows = [r for r in rows if keep[r[0]][2]]
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(r[0] for r in rows)
    now = step("near_dedup", now)
    keep = cases.near(rows)
    rows = [r for r in rows if keep[r[0]][2]]
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(r[0] for r in rows)
    mixed = step("mixing", now)
    ids = [r["doc_id"] for r in mixed.collect()]
    assert set(ids) <= {r[0] for r in rows} and max(ids.count(i) for i in set(ids)) <= 3
    packed = stages["packing"](spark, mixed, "").toPandas()
    assert packed[packed.start == 0].groupby("doc_id").size().to_dict() == {i: ids.count(i) for i in set(ids)}


def test_mixing_decides_by_row(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"w{i} " * (20 + i % 9), "en", ("a", "b")[i % 4 == 0])
            for i in range(400)]
    docs = cases.table(spark, rows)
    mixed = dict(P.STAGES)["mixing"](spark, docs, "").collect()
    size = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in "ab"}
    want = {"a": sum(size.values()) / 3, "b": sum(size.values()) * 2 / 3}
    taken = {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in "ab"}
    assert all(abs(taken[s] - want[s]) <= 28 for s in "ab")
    each = Counter(r["text"] for r in mixed)
    assert max(each.values()) <= 3 and {each[t] for _, t, _, s in rows if s == "a"} == {0, 1}


def test_registered_and_removable():
    import __spark_entry__ as entry
    names = list(entry.queries())
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op"))
    assert "pipeline" in names and numbers == list(range(1, 14))
