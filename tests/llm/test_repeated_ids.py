"""A passage shared by rows whose ids repeat in any order within one chunk."""

from glyphmill.llm import anchors
from tests.llm import cases

PASSAGE = " ".join(f"p{i}" for i in range(13))


def removed(spark, ids):
    rows = [(i, f"start{n} {PASSAGE} end{n}", "en", "s") for n, i in enumerate(ids)]
    df = cases.table(spark, rows, 1).sortWithinPartitions("text")  # the order given, in one chunk
    got = [(r["doc_id"], r["n_removed"]) for r in anchors.remove_repeats(df).collect()]
    assert [i for i, _ in got] == ids
    return [n for _, n in got]


def test_anchor_between_equal_ids(spark):
    assert removed(spark, [5, 7, 5]) == [0, 13, 0]
    assert removed(spark, [7, 5, 7]) == [13, 0, 13]
    assert removed(spark, [5, 5, 5]) == [0, 0, 0]
