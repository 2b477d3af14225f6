"""Personal data: fixed patterns, plus spans found by a character BiLSTM with CRF transitions.

Kinds: email, ip, card, phone.  The base spans are the patterns' matches, each kind on its
own.  The tagger is trained in NumPy on a bounded sample of windows (``TRAIN_WINDOWS``) whose
labels are base spans of the documents themselves, and only its weights are broadcast.

Every kind's spans hold a digit or an ``@``, so the tagger reads each region within ``REACH``
code points of such a character: the whole of every text is looked through, and a text
without one has no span by definition.  A region is cut into overlapping windows; their
emissions are averaged, weighted towards window centres, and one CRF decoding runs over the
whole region, so that a span across windows is found once.  Tagger spans that overlap no
base span are added when their mean margin reaches ``MIN_MARGIN`` and they have the form
their kind cannot do without.

Edge cases: a null or empty text has no spans; offsets are code points, end exclusive;
repeated rows get equal results; a null ``doc_id`` is kept; without training windows only the
base spans are returned; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb
from glyphmill.llm.bilstm_crf import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
REACH = 24
WINDOW, STRIDE = 64, 32
#: Bound of the training sample, in windows; half of them without a span.
TRAIN_WINDOWS = 768
MIN_MARGIN = 4.0
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(_DIGITS.fullmatch(p) and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern in linear time: each @ has one longest local part before it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The ip pattern in linear time: four digit groups in turn with one dot between each."""
    groups: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        if groups and not (m.start() == groups[-1][1] + 1 and text[m.start() - 1] == "."):
            groups = []
        groups.append(m.span())
        if len(groups) == 4:
            yield groups[0][0], groups[3][1]
            groups = []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' valid matches, in order."""
    found = [_emails(text), _ips(text), (m.span() for m in PATTERNS["card"].finditer(text)),
             (m.span() for m in PATTERNS["phone"].finditer(text))]
    return sorted((a, number, b) for number, (kind, spans) in enumerate(zip(KINDS, found, strict=True))
                  for a, b in spans if valid(kind, text[a:b]))


def regions(text: str) -> list[tuple[int, int]]:
    """Merged stretches within REACH of a digit or an @."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def window_starts(lo: int, hi: int) -> list[int]:
    edge = (WINDOW - STRIDE) // 2
    return list(range(lo - edge, max(hi - WINDOW + edge, lo - edge) + STRIDE, STRIDE))


def window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    a, b = max(0, start), min(len(codes), start + WINDOW)
    if b > a:
        out[a - start: b - start] = codes[a:b]
    return out


def tags(spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for a, kind, b in spans:
        lo, hi = max(a, start), min(b, start + WINDOW)
        if hi > lo and not out[lo - start: hi - start].any():
            out[lo - start: hi - start] = 2 + 2 * kind
            if a >= start:
                out[a - start] = 1 + 2 * kind
    return out


def _with_marks(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts hold a digit or an @ at all."""
    out = np.zeros(len(offs) - 1, bool)
    for lo, hi in tb.slices(offs):
        seen = np.flatnonzero(_MARK[body[offs[lo]: offs[hi]]]) + offs[lo]
        out[lo + np.unique(np.searchsorted(offs[lo + 1: hi + 1], seen, side="right"))] = True
    return out


def _text(body: np.ndarray, offs: np.ndarray, i: int) -> str:
    return body[offs[i]: offs[i + 1]].tobytes().decode("utf-8", "replace")


def fit(docs: DataFrame, windows: int = TRAIN_WINDOWS, seed: int = 7) -> Tagger | None:
    """Train on the distinct windows with the smallest hashes: half with a base span, half without."""
    half = windows // 2

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bool, set[tuple[int, bytes, bytes]]] = {True: set(), False: set()}
        for batch in batches:
            body, offs = tb.column(batch.column("text"))
            for i in np.flatnonzero(_with_marks(body, offs)).tolist():
                text = _text(body, offs, i)
                codes, spans = classes(text), base_spans(text)
                for lo, hi in regions(text):
                    for start in window_starts(lo, hi):
                        labels = tags(spans, start)
                        x = window(codes, start).astype(np.uint8).tobytes()
                        y = labels.astype(np.uint8).tobytes()
                        rank = int.from_bytes(hashlib.blake2b(
                            bytes([seed]) + x + y + text[max(0, start): start + WINDOW].encode("utf-8", "replace"),
                            digest_size=7).digest(), "big")
                        mine = least[bool(labels.any())]
                        mine.add((rank, x, y))
                        if len(mine) > 8 * half + 64:  # what the whole table takes is among each task's smallest
                            mine.intersection_update(heapq.nsmallest(half, mine))
        rows = [(*r, has) for has, mine in least.items() for r in heapq.nsmallest(half, mine)]
        if rows:
            order, x, y, has = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(has, pa.bool_()),
                                              pa.array(x, pa.binary()), pa.array(y, pa.binary())],
                                             names=["rank", "has", "x", "y"])

    rows = docs.select("doc_id", "text").mapInArrow(fn, "rank long, has boolean, x binary, y binary").distinct()
    # one pass: the half with spans comes first among the smallest ranks of either half
    some = rows.filter("has").orderBy("rank", "x", "y").limit(half).unionByName(
        rows.filter("NOT has").orderBy("rank", "x", "y").limit(half)).collect()
    if not any(r["has"] for r in some):
        return None
    some.sort(key=lambda r: (r["rank"], bytes(r["x"]), bytes(r["y"])))
    x = np.stack([np.frombuffer(r["x"], np.uint8) for r in some]).astype(np.int64)
    y = np.stack([np.frombuffer(r["y"], np.uint8) for r in some]).astype(np.int64)
    model = Tagger(TAGS)
    model.train(x, y)
    return model


_WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])


def tagged_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, margin) per text: windows averaged, then one decoding per region."""
    places = []  # text, region, first window, number of windows
    rows: list[np.ndarray] = []
    for i, text in enumerate(texts):
        codes = classes(text)
        for lo, hi in regions(text):
            starts = window_starts(lo, hi)
            places.append((i, lo, hi, starts, len(rows)))
            rows += [window(codes, s) for s in starts]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not rows:
        return out
    x = np.stack(rows)
    scores = np.concatenate([model.emissions(x[a: a + 512]) for a in range(0, len(x), 512)])
    for i, lo, hi, starts, at in places:
        total, weight = np.zeros((hi - lo, TAGS)), np.zeros(hi - lo)
        for j, s in enumerate(starts):
            a, b = max(lo, s), min(hi, s + WINDOW)
            if b > a:
                w = _WEIGHT[a - s: b - s]
                total[a - lo: b - lo] += scores[at + j, a - s: b - s] * w[:, None]
                weight[a - lo: b - lo] += w
        e = total / np.maximum(weight, 1e-9)[:, None]
        path, margin, t = model.decode(e), model.margin(e), 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            kind, begin = (path[t] - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * kind:
                t += 1
            out[i].append((lo + begin, int(kind), lo + t, float(margin[begin:t].mean())))
    return out


def has_form(kind: int, found: str) -> bool:
    """What a span of the kind cannot do without, looser than the base pattern."""
    digits = sum(c.isdigit() for c in found)
    return (("@" in found.strip("@") and "." in found), digits >= 4 and found.count(".") >= 3,
            12 <= digits <= 19, 7 <= digits <= 15 and found[0] in "+(0123456789")[kind]


def added_spans(text: str, base: list, tagged: list) -> list[tuple[int, int, int]]:
    out = []
    for a, kind, b, margin in tagged:
        clash = any(a < d and c < b for c, _, d in base)
        if margin >= MIN_MARGIN and not clash and text[a:b].strip() == text[a:b] and has_form(kind, text[a:b]) \
                and (kind not in (1, 2) or valid(KINDS[kind], text[a:b])):
            out.append((a, kind, b))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (all), n_added, for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    nothing = hashlib.sha256(b"").hexdigest()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            body, offs = tb.column(batch.column("text"))
            n = len(offs) - 1
            counts = np.zeros((4, n), np.int64)
            sha, spans, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
            marked = np.flatnonzero(_with_marks(body, offs)).tolist()
            for g in range(0, len(marked), 64):
                group = marked[g: g + 64]
                texts = [_text(body, offs, i) for i in group]
                tagged = tagged_spans(m, texts) if m is not None else [[] for _ in texts]
                for i, text, t in zip(group, texts, tagged, strict=True):
                    base = base_spans(text)
                    more = added_spans(text, base, t)
                    for _, k, _ in base:
                        counts[k, i] += 1
                    added[i] = len(more)
                    sha[i] = hashlib.sha256(_written(base).encode()).hexdigest()
                    spans[i] = _written(sorted(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c) for c in counts], pa.array(sha, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added)],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(
        fn, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
            "spans string, n_added long")
