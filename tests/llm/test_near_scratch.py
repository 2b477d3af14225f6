"""Near-duplicate search leaves only the scratch tables that its result reads."""

from pathlib import Path

from glyphmill.llm import minhash
from glyphmill.session import checkpoint_dir
from tests.llm import cases


def test_tables_are_dropped(spark):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("glyphmill-*/*"))
    rows = [(i, " ".join(f"w{i // 4}x{j}" for j in range(40 + i % 2)), "en", "s") for i in range(40)]
    found = minhash.near_duplicates(cases.table(spark, rows))
    left = {p.name for p in set(folder.glob("glyphmill-*/*")) - before}
    assert not left & {"minhash-representatives", "minhash-bucket-rows", "minhash-sets", "minhash-wanted"}, left
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i // 4 * 4 for i in range(40)}
