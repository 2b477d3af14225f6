"""Line dedup against a brute-force version, with runs cut at partition edges and odd ids."""

import random
from collections import Counter

import pytest

from glyphmill.llm import line_dedup as ld

from . import cases

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return cases.lower(line.strip(SPACES))


def brute(rows, min_chars=ld.MIN_CHARS, min_docs=ld.MIN_DOCS):
    """(doc_id, n_lines, n_dropped, sha256) of each row; a null id is one document below all others."""
    who = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(who(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == who(i)]
        out.append((i, len(lines), len(lines) - len(kept), cases.sha("\n".join(kept).encode())))
    return out


def awkward_lines():
    rng = random.Random(11)
    hot = ["This line stands in very many documents of the corpus.", "ÉTÉ Ünï line with letters that only A-Z folding leaves 😀"]
    rows = []
    for i in range(120):
        lines = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        lines += [hot[0].upper() if rng.random() < .5 else "\t " + hot[0] + " \r"] * rng.randint(0, 3)
        lines += [hot[1]] * (i % 9 == 0)
        lines += ["exactly four of them hold this line, so it stays where it is"] * (i in (3, 30, 60, 90))
        lines += ["exactly five of them hold this line, so only one keeps its copy"] * (i in (3, 30, 60, 90, 119))
        lines += ["x" * 39] * (i % 2) + ["y" * 40] * (i % 3 == 0)
        rng.shuffle(lines)
        rows.append((i * 7 % 120 - 20, "\n".join(lines), None, None))
    rows += [(500, "one", None, None), (501, "", None, None), (502, None, None, None), (503, "\n\n", None, None),
             (504, "z" * 100_000 + "\n" + hot[0], None, None), (2**63 - 1, hot[0], None, None), (-2**63, hot[0], None, None)]
    for i in (None, None, 7, 7):                          # null and repeated ids, with equal and with other texts
        rows += [(i, hot[0] + "\nsame", None, None), (i, "other\n" + hot[0] + "\n" + hot[0], None, None)]
    return rows


def got(frame):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize(("held", "partitions"), [(ld.HELD_ROWS, 3), (2, 8), (0, 61)])
def test_brute_force(spark, monkeypatch, held, partitions):
    rows = awkward_lines()
    monkeypatch.setattr(ld.stream_runs, "__defaults__", (held,))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert got(ld.drop_lines(cases.table(spark, rows))) == Counter(brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows_texts_and_parameters(spark):
    rows = [(i, f"{t}\n{t}" if t else t, *r) for i, t, *r in cases.awkward_rows()]
    out = ld.drop_lines(cases.table(spark, rows), min_chars=3, min_docs=2, with_text=True)
    assert got(out) == Counter(brute(rows, 3, 2))
    assert all(cases.sha(r.kept_text.encode()) == r.kept_sha256 for r in out.collect())


def test_bitmaps(spark):
    rows = [(i, "\n".join(["a" * 50, "stays", "b" * 50])) for i in range(6)]
    maps = ld.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in maps) == [0, 1, 2, 3, 4] and {r.n_dropped for r in maps} == {2}
    assert all(ld.unpack_keep(r.keep, 20).tolist() == [False, True, False] + [True] * 17 for r in maps)


def test_empty(spark):
    assert ld.drop_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
