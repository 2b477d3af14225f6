"""The filter audit and its matrix against brute force."""

import random
from itertools import permutations

from glyphmill.llm import filter_audit as fa
from glyphmill.llm.common import save

from . import cases


def failures(rows):
    """For each row, its part and the letters it fails."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = cases.words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
               "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
               "E": i is not None and i > least[t]}
        out.append((lang or "", i, {k for k, v in bad.items() if v}))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    found, out = failures(rows), {}
    for part in {p for p, *_ in found}:
        mine = [(i, f) for p, i, f in found if p == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                lost = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                out[part, "".join(order), step] = [
                    len(left), len(lost), sum(letter in f for _, f in mine) - len(lost), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
    for (part, order, step), row in out.items():
        letter = order[step - 1]
        row.append(sum(out[part, "".join(o), o.index(letter) + 1][1] for o in permutations("ABCDE")))
    return out


def awkward():
    rng = random.Random(12)
    rows = [(i, t, lang) for i, t, lang, _ in cases.awkward_rows()]
    for i in range(60):
        n = rng.choice([150, 199, 200, 260, 400])
        t = " ".join(rng.choice(["word", "Word", "LOUD", "été", "x\x1cy", f"w{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}"]) for _ in range(n))
        rows.append((1000 + i, t + rng.choice(["", "", " a#b", " 5%", "\x0b|"]), rng.choice(["en", "", None, "xx"])))
    rows += [(2000 + i, rows[40][1], "en") for i in range(30)] + [(2000, rows[41][1], "en"), (2000, rows[41][1], "fr")]
    rows += [(None, rows[40][1], "en"), (None, rows[40][1], "en"), (None, None, None), (-2**63, "", "fr"), (2**63 - 1, "", "fr")]
    rows += [(3000, " ".join(["ab cd"] * 100), "en"), (3001, " ".join(f"q{i}" for i in range(30_000)), "en")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows[::2]] + [(2000, 0, 1), (2000, 1, 0), (9999, 1, 1), (None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    wide = [(*r, "p", 7, 8, 9) for r in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, part string, mask int, shard long, _least long").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fa, "SHARD_BYTES", 3000)
    rows, labels = awkward()
    out = fa.audit(*frames(spark, rows, labels)).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in out} == brute(rows, labels)
    assert len(out) == 600 * len({p for p, *_ in failures(rows)})


def test_matrix_counts_words_under_one_number(spark, monkeypatch):
    rows, labels = awkward()
    docs, _ = frames(spark, rows, labels)
    flags = {(r.doc_id, r.n_words, r.n_distinct) for r in fa.document_flags(docs).collect()}
    assert flags == {(i, len(cases.words(t)), len(set(cases.words(t)))) for i, t, _ in rows}
    rows = docs.selectExpr("doc_id", "text", "lang AS part", "1L AS f1", "2L AS f2")
    words = sorted({w.encode() for _, t, _ in awkward()[0] for w in cases.words(t)})
    numbered = fa.dictionary(fa.shards(rows, with_words=True)).collect()
    assert sorted(bytes(r.word) for r in numbered) == words
    assert len({r.number for r in numbered}) == len(words)


def test_global_csr(spark):
    docs, _ = frames(spark, [(1, "b a b", "en"), (2, "", "en"), (3, "c a", "en")], [(1, 1, 1)])
    found = fa.shards(docs.selectExpr("doc_id", "text", "lang AS part", "1L AS f1", "2L AS f2"), with_words=True)
    number = {bytes(r.word).decode(): r.number for r in fa.dictionary(found).collect()}
    order = {(r.shard, r.at): r.doc_id for r in found.filter("at >= 0").collect()}
    cells = {}
    for r in fa.matrix(found).collect():
        for i in range(r.n_rows):
            part = slice(r.indptr[i], r.indptr[i + 1])
            assert r.indices[part] == sorted(r.indices[part])
            cells[order[r.shard, i]] = dict(zip(r.indices[part], r.data[part], strict=True))
    assert cells == {1: {number["a"]: 1, number["b"]: 2}, 2: {}, 3: {number["a"]: 1, number["c"]: 1}}


def test_empty(spark):
    docs, labels = frames(spark, [(1, "a", "en")], [(1, 1, 1)])
    assert fa.audit(docs.limit(0), labels).collect() == []
    assert fa.audit(docs, labels.limit(0)).count() == 600
