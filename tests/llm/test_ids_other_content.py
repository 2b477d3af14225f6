"""Rows that share an id but not their content: no link of either content is lost."""

import numpy as np

from glyphmill.llm import embed_dedup, minhash
from tests.llm import cases


def near(words):
    return " ".join([*words[:-1], "changed"])


def test_near_texts(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(1, " ".join(a), "en", "s"), (1, " ".join(b), "en", "s"), (2, near(a), "en", "s"), (3, near(b), "en", "s"),
            (3, " ".join(a), "en", "s"), (4, "nothing like the others at all", "en", "s")]
    for parts in (1, 4):
        got = minhash.near_duplicates(cases.table(spark, rows, parts)).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [
            (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 16))
    rows = [(1, a, 0), (1, b, 0), (2, a + 0.01, 0), (3, b + 0.01, 0), (3, b, 1), (4, b, 1), (4, -a, 0)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_vectors(df.repartition(3)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [
        (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 3), (4, 0, 4), (4, 1, 3)]
