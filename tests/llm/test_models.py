import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import langid, lm_scoring, mixing, packing, pii
from glyphmill.llm.bilstm_crf import Tagger
from glyphmill.llm.common import residue
from glyphmill.llm.queries import tokenizer_path
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.table(spark, rows).cache()


def test_lm_base_and_score(docs, rows):
    out = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    tokens = {i: [*cases.words(cases.lower(t)), None] for i, t, *_ in rows}
    train = [i for i in tokens if cases.crc(i, 7) != 2]
    c = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in itertools.pairwise([0, *tokens[i]]))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for i, ws in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["held_out"] == (cases.crc(i, 7) == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert math.isfinite(r["score"]) and r["score"] < 0
    for i, expected in mixture_scores(tokens, train).items():
        assert out[i]["score"] == pytest.approx(expected, abs=1e-6)
    assert pairs[0, None] >= 3


def mixture_scores(tokens, train):
    """Each text's score restated over plain counts: weights from the fold under the rest's, then the mixture."""
    def counts(ids):
        pairs = Counter(p for i in ids for p in itertools.pairwise([0, *tokens[i]]))
        c = Counter(w for i in ids for w in tokens[i])
        return pairs, c, c + Counter({0: len(ids)}), sum(c.values()), len(c)

    def steps(top, bottom):  # a histogram cell: eighths of an octave below 1
        return 1 + round(-math.log2(top / bottom) * 8) if top else 0
    fold = [i for i in train if cases.crc(i, 7) == lm_scoring.FOLD]
    pairs, c, context, n, _ = counts([i for i in train if i not in fold])
    cells = Counter()
    for i in fold:
        for h, w in itertools.pairwise([0, *tokens[i]]):
            cells[(context[h].bit_length() << 40) | (steps(pairs[h, w], context[h]) << 20) | steps(c[w], n)] += 1
    pairs, c, context, n, v = counts(train)
    weights = lm_scoring.learn_weights(cells, v)
    out = {}
    for i, ws in tokens.items():
        out[i] = 0.0
        for h, w in itertools.pairwise([0, *ws]):
            a = weights[context[h].bit_length()]
            out[i] += math.log10(a[0] * pairs[h, w] / max(context[h], 1) + a[1] * c[w] / n + a[2] / (v + 1))
    return out


def test_lm_mixture_is_a_distribution():
    w = lm_scoring.learn_weights({(3 << 40) | (9 << 20) | 33: 5, (1 << 40) | 50: 7, 40: 3}, 100)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0
    assert w[3, 0] > 0.9 and (w[9] == w[3]).all()


def test_lm_beats_unigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_scoring.score(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.3


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = residue("doc_id", 3) == 1
    out = langid.predict(docs, langid.fit(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").filter(held)
    rows = out.collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, docs, rows):
    model = langid.fit(docs, residue("doc_id", 3) != 1)
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for i, t, *_ in rows:
        assert (out[i]["lang_pred"] == "und") == (not any(ch.isalpha() for ch in t or ""))
    assert langid.fit(cases.table(spark, [], 1), residue("doc_id", 3) != 1) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(v["lang_pred"] != "und" for v in out.values())


def test_presence_is_the_set_of_grams():
    texts = [b"Banana", b"", b"an", "été".encode()]
    body = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.presence(body, offs)
    for i, t in enumerate(texts):
        alone = langid.presence(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (got[i] == alone[0]).all()
        grams = {t.lower()[a:a + n] for n in range(1, 5) for a in range(len(t) - n + 1)}
        assert got[i].sum() <= len(grams) and got[i].sum() >= len(grams) - 1


def base_by_pattern(text):
    return sorted((m.start(), n, m.end()) for n, k in enumerate(pii.KINDS) for m in pii.PATTERNS[k].finditer(text)
                  if pii.valid(k, m.group()))


def test_pii_base_spans_are_the_patterns():
    rng = np.random.default_rng(1)
    letters = list("aB9@.-+ ()1_4%x\n2é")
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        assert pii.base_spans(text) == base_by_pattern(text)


def test_pii_query_keeps_base_spans(docs, rows):
    out = {r["doc_id"]: r for r in pii.find(docs, pii.fit(docs)).collect()}
    for i, t, *_ in rows:
        base = base_by_pattern(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert out[i]["base_sha256"] == cases.sha(text.encode())
        assert {x for x in text.split(",") if x} <= {x for x in out[i]["spans"].split(",") if x}
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]


def test_tagger_gradient_and_windows():
    rng = np.random.default_rng(2)
    m = Tagger(3, hidden=3)
    x, y = rng.integers(0, 9, (2, 6)), rng.integers(0, 3, (2, 6))
    _, grads = m._grads(x, y)
    for name in ("fh", "bx", "o", "a", "ob"):
        at = tuple(rng.integers(0, s) for s in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up, _ = m._grads(x, y)
        m.p[name][at] = old - 1e-5
        down, _ = m._grads(x, y)
        m.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    for lo, hi in ((0, 1), (5, 90), (0, 64), (10, 400)):
        seen = np.zeros(hi + 100, bool)
        for s in pii.window_starts(lo, hi):
            seen[max(0, s): s + pii.WINDOW] = True
        assert seen[lo:hi].all()


def test_mixing(spark, docs, rows):
    out = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {i: len(cases.words(t)) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, list(names), float(sum(total.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * total[s]]
        for s in full or free:
            target[s] = 3.0 * total[s] if full else level * weight[s]
            rest -= target[s] if full else 0
        free = [s for s in free if s in full] and [s for s in free if s not in full] if full else []
    for i in size:
        r = out[i]
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]])
        assert r["target"] == pytest.approx(target[source[i]])
        low = math.floor(target[source[i]] / max(1, total[source[i]]) + 1e-9)
        assert r["taken"] in ((low * size[i]), (low + 1) * size[i]) and r["taken"] <= 3 * size[i]
    for s in names:  # all but one unit's words are balanced
        ids = [i for i in size if source[i] == s]
        assert abs(sum(out[i]["taken"] for i in ids) - target[s]) <= max(size[i] for i in ids) + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in out.items()}


def test_pivotal_tree_keeps_words_and_expectations(spark):
    units = spark.range(4000).selectExpr("id AS doc_id", "1 + pmod(id * 7919, 50) AS size", "id % 2 AS grp", "0.3D + 0.2D * (id % 2) AS p")
    out = mixing.pivotal_round(units, fan_in=16).toPandas()
    assert len(out) == 4000 and set(out.extra) == {0, 1}
    for g in (0, 1):
        x = out[out.doc_id % 2 == g]
        assert abs((x.extra * x["size"]).sum() - (0.3 + 0.2 * g) * x["size"].sum()) <= 50
        assert abs(x.extra.mean() - (0.3 + 0.2 * g)) < 0.03


def test_packing(docs, rows):
    from tokenizers import Tokenizer
    import zlib
    coder = Tokenizer.from_file(tokenizer_path())
    out = packing.pack(docs, tokenizer_path()).toPandas()
    ids = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in rows}
    for i, g in out.sort_values("start").groupby("doc_id"):
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids[i])
        assert (g.doc_tokens == len(ids[i])).all()
        for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert zlib.crc32(ids[i][a:a + n].tobytes()) == c
    assert set(out.doc_id) == set(ids)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= 4096 and len(g) <= packing.MAX_SEGMENTS
        n = int(g.length.sum())
        assert n == 4096 or n & (n - 1) == 0


def test_packer_holds_all_limits():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 200, 600)
    loss = (tokens * rng.random(600)).astype(np.int64)
    p = packing.Packer(limits=(256, 6, 128), cut=False, pool=100)
    tight = packing.Packer(limits=(256, 6, 1), cut=False)
    tight.add(*[np.array([x]) for x in (0, 0, 9, 9)])
    with pytest.raises(ValueError):
        tight.finish()
    loss = np.minimum(loss, 128)
    p.add(np.arange(600), np.zeros(600, np.int64), tokens, loss)
    p.finish()
    placed = [x for seq in p.done for x in seq]
    assert sorted(x[0] for x in placed) == list(range(600))
    for seq in p.done:
        assert sum(x[2] for x in seq) <= 256 and len(seq) <= 6 and sum(x[3] for x in seq) <= 128


def test_empty_tables(spark):
    none = cases.table(spark, [], 1)
    assert lm_scoring.score(none).count() == 0
    assert pii.find(none, pii.fit(none)).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert re.match(".*word_bpe", tokenizer_path())
