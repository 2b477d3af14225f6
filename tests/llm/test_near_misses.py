"""Large groups in which most pairs narrowly miss the threshold: no link is lost, none is made up."""

import random

import pytest

from glyphmill.llm import minhash
from tests.llm import cases


@pytest.mark.parametrize("best,tile", [(1, 16), (4, 4096)])
def test_family_of_near_misses(spark, monkeypatch, best, tile):
    monkeypatch.setattr(minhash, "BEST", best)
    monkeypatch.setattr(minhash, "TILE", tile)
    draw = random.Random(best)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in draw.sample(range(120), draw.choice([1, 2, 3, 4, 5])):
            words[at] = f"x{draw.randrange(1000)}"
        rows.append((i + 1, " ".join(words), "en", "s"))
    want = cases.near(rows)
    assert 1 < len({c for _, c, _ in want.values()}) < 160
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.near_duplicates(cases.table(spark, rows)).collect()}
    assert got == want
