"""A small table with the awkward cases, and plain restatements of what each operator computes."""

import hashlib
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, ties, long and odd texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(40)
    texts = [base, base, base.replace(" ", "  "), base.upper(), " " + base, prose(90) + " " + passage + " " + prose(30),
             passage + "\n" + prose(60), prose(25) + "\t" + passage, passage, "", None, " \n ", "one", "one two three four",
             "one two three four", "a" * 400, "a" * 400 + "b", "été \U0001F600 naïve " * 30,
             "été \U0001F600 naïve " * 29, "12345 !!!", prose(9000), "x y z\x1fw", prose(13), prose(12),
             "mail a.b@c-d.org or 10.2.3.255, 10.2.3.256 +1 (386) 555-3733 4379480889597802 1 2 3"]
    near = base.split()
    for i in range(30):
        other = list(near)
        other[(i * 7) % len(other)] = f"changed{i}"
        texts.append(" ".join(other))
    chain = prose(100).split()
    for i in range(6):
        texts.append(" ".join(chain))
        chain = chain[4:] + prose(4).split()
    rows = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], ("s2", "s1", None, "big")[i % 4]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, bucket string, _salt int, _b int, _row int"


def table(spark, rows, partitions=3):
    """The rows with further columns whose names the operators use themselves."""
    wide = [(*r, 1, "b", 2, 3, 4) for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(partitions)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def components(ids, links):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault("".join(words(t)), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, sha(k.encode())) for k, g in groups.items() for _, i in g}


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def repeats(rows, unit, width):
    """Flags of the units that a window covers which a smaller id starts too."""
    seqs = {i: unit(t) for i, t, *_ in rows}
    first = {}
    for i in sorted(seqs):
        for j in range(len(seqs[i]) - width + 1):
            first.setdefault(tuple(seqs[i][j:j + width]), i)
    out = {}
    for i, s in seqs.items():
        gone = [False] * len(s)
        for j in range(len(s) - width + 1):
            if first[tuple(s[j:j + width])] < i:
                gone[j:j + width] = [True] * width
        out[i] = (s, gone)
    return out
