"""Importance resampling and its radix sort against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import resample as rs
from glyphmill.llm.common import save

from . import cases

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run=1):
    w = WORD.findall(cases.lower(text))
    return [" ".join(w[i:i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, run=1, buckets=rs.BUCKETS, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t, *_ in rows for f in features(t, run))
    t_ = Counter(bucket(f) for t in target for f in features(t, run))
    ss, tt = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for i, t, *_ in rows:
        fs = features(t, run)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(ranked[:percent * len(ranked) // 100], 1):
        r[4] = rank
    return Counter(map(tuple, out))


def awkward():
    rows = cases.awkward_rows()
    rng = random.Random(13)
    for i in range(150):
        n = rng.choice([0, 19, 20, 21, 60])
        rows.append((5000 - 61 * i, " ".join(rng.choice(["Pear", "apple", "été", "x_y", "日本", "a1-b2"]) for _ in range(n)), None, None))
    same = " ".join(["apple"] * 25)
    rows += [(None, same, None, None)] * 3 + [(None, same + " pear", None, None), (7, same, None, None), (7, same, None, None)]
    rows += [(2**63 - 1, same, None, None), (-2**63, same, None, None)]
    return rows


def got(frame):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize(("run", "percent"), [(1, 10), (1, 100), (2, 55)])
def test_brute_force(spark, monkeypatch, run, percent):
    monkeypatch.setattr(rs, "BLOCK", 4)
    monkeypatch.setattr(rs, "LEVEL", 3)
    rows, target = awkward(), ["apple pear apple", None, "", "日本 x"]
    out = rs.resample(cases.table(spark, rows), spark.createDataFrame([(1, t) for t in target], "item_id int, text string"),
                      run=run, percent=percent)
    assert got(out) == brute(rows, target, run, percent=percent)


def test_radix_sort_is_stable_and_dense(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK", 8)
    monkeypatch.setattr(rs, "LEVEL", 2)
    rng = random.Random(3)
    keys = [(rng.choice([0, 5, 2**40, -1, -2**63, 2**63 - 1]), rng.randint(0, 3000)) for _ in range(500)]
    rows = save(spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, a long, b long").coalesce(1).sortWithinPartitions("i"), "rows")
    out = rs.radix_sort(rows, [rs._unsigned("a"), F.col("b")]).orderBy("place").collect()
    assert [r.place for r in out] == list(range(500))
    assert [r.i for r in out] == sorted(range(500), key=lambda i: (keys[i], i))


def test_one_value_and_no_rows(spark):
    rows = [(i, "a " * 30) for i in (3, 1, 2)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert got(rs.resample(docs, target, percent=100)) == brute(rows, [], percent=100)
    assert rs.resample(docs.limit(0), target).collect() == []
    few = [(1, "short"), (2, None)]
    assert got(rs.resample(spark.createDataFrame(few, "doc_id long, text string"), target)) == brute(few, [])
