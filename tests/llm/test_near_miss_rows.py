"""A group of near misses costs comparisons, not rows: no table of the job holds its pairs."""

import random

from glyphmill.llm import minhash
from tests.llm import cases


def test_tables_stay_linear(spark, monkeypatch):
    kept = {}

    def counted(df, name, *more, save=minhash.save):
        out = save(df, name, *more)
        kept[name] = max(kept.get(name, 0), out.count())
        return out
    monkeypatch.setattr(minhash, "save", counted)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):  # most pairs lie between 0.6 and 0.75, some link
        words = list(base)
        for at in draw.sample(range(120), 3):
            words[at] = f"x{draw.randrange(100_000)}"
        rows.append((i + 1, " ".join(words), "en", "s"))
    want = cases.near(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.near_duplicates(cases.table(spark, rows)).collect()}
    assert got == want
    most = kept["minhash-bucket-rows"] if "minhash-apart" not in kept else kept["minhash-apart"]
    assert max(kept.values()) <= (minhash.BEST + 1) * most, kept
