import numpy as np
import pytest

from glyphmill.llm import anchors, common, components, embed_dedup, exact_dedup, minhash, suffix_dedup
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.table(spark, rows).cache()


def got(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_exact(docs, rows):
    df = common.null_safe_join(exact_dedup.exact_dedup(docs), exact_dedup.text_digests(docs), ["doc_id"])
    assert got(df, "keep_id", "group_size", "kept", "text_sha256") == cases.exact(rows)


def test_near(docs, rows, monkeypatch):
    assert got(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == cases.near(rows)
    for name, value in (("TILE", 3), ("BEST", 1), ("GROWTH", 2)):  # many tiles and rounds
        monkeypatch.setattr(minhash, name, value)
    assert got(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == cases.near(rows)


def test_word_windows(docs, rows):
    want = {i: (len(s), sum(g), cases.sha(" ".join(w for w, x in zip(s, g, strict=True) if not x).encode()))
            for i, (s, g) in cases.repeats(rows, cases.words, 13).items()}
    df = anchors.remove_repeats(docs)
    assert got(df, "n_words", "n_removed", "kept_sha256") == want
    assert sum(v[1] for v in want.values()) > 100


def test_byte_windows(docs, rows):
    want = {}
    for i, (s, g) in cases.repeats(rows, lambda t: (t or "").encode(), 50).items():
        runs = sum(x and not p for p, x in zip([False, *g], g, strict=False))
        want[i] = (len(s), sum(g), runs, cases.sha(bytes(b for b, x in zip(s, g, strict=True) if not x)))
    assert got(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_small_chunks_and_buckets_agree(docs, monkeypatch):
    """Many chunks, buckets and splitters give the same rows as one."""
    from glyphmill.llm import exchange
    one = got(suffix_dedup.remove_repeats(docs, False), "n_removed", "kept_sha256")
    two = got(anchors.remove_repeats(docs, False), "n_removed", "kept_sha256")
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 4000)
    assert got(suffix_dedup.remove_repeats(docs, False), "n_removed", "kept_sha256") == one
    assert got(anchors.remove_repeats(docs, False), "n_removed", "kept_sha256") == two


def test_multikey_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (500, 50), dtype=np.uint8)
    rows[100:200] = rows[0]
    order, common_bytes = suffix_dedup.multikey_sort(rows)
    text = [r.tobytes() for r in rows[order]]
    assert text == sorted(text)
    for a, b, n in zip(text, text[1:], common_bytes[1:], strict=False):
        assert a[:n] == b[:n] and (n == 50 or a[n] != b[n])


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    want = cases.components({x for p in links for x in p}, links)
    found = {r["id"]: r["component"] for r in components.components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {i: want[i] for i in linked}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows = [(i, base[i % 40].tolist(), i % 3) for i in range(60)]
    rows += [(100 + i, (base[0] + rng.normal(size=24) * 0.1).tolist(), 0) for i in range(30)]
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [1.0, None] + [0.0] * 22, 1), (203, [float("nan")] * 24, 1),
             (204, base[1].tolist(), None), (205, [], 1), (206, [3.0, 4.0], 1), (207, [6.0, 8.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr(
        "*", "1 AS cell", "2 AS raw", "3 AS mult")
    good = {i: (np.array(v), k) for i, v, k in rows
            if v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, (x, k) in good.items() for b, (y, m) in good.items() if a < b and k == m and len(x) == len(y)
             and x @ y / np.sqrt((x @ x) * (y @ y)) >= embed_dedup.COSINE]
    comp = cases.components([r[0] for r in rows], links)
    want = {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i, *_ in rows}
    assert len(links) > 100
    for tile in (embed_dedup.TILE, 8):
        out = embed_dedup.near_vectors(df, tile=tile)
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()} == want


def test_empty_tables(spark):
    none = cases.table(spark, [], 1)
    for fn in (exact_dedup.exact_dedup, minhash.near_duplicates, anchors.remove_repeats, suffix_dedup.remove_repeats):
        assert fn(none).count() == 0
    assert embed_dedup.near_vectors(spark.createDataFrame(
        [], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = cases.table(spark, [(1, text, "en", "a"), (1, text, "en", "a"), (None, text, "en", "a"), (2, text, None, None)])
    assert exact_dedup.exact_dedup(df).count() >= 4
    near = sorted((str(r["doc_id"]), r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert near == [("1", 1), ("1", 1), ("2", 1), ("None", None)]
    gone = sorted((str(r["doc_id"]), r["n_removed"]) for r in anchors.remove_repeats(df).collect())
    assert gone == [("1", 30), ("1", 30), ("2", 30), ("None", 0)]
    assert suffix_dedup.remove_repeats(df).count() == 4
