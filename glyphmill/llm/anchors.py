"""Repeated 13-word passages by difference-cover anchors.

Windows of ``ANCHOR`` words are hashed only where the word position modulo ``PERIOD`` is in
``COVER``.  Every difference modulo the period is a difference of two cover members, so two
equal 13-word windows, wherever they stand, have an offset below the period at which both
positions are cover positions: they share an aligned anchor.

1. Each chunk of texts sends its distinct anchors to hash buckets and learns which ones
   another document has too.
2. Around shared anchors only, the full 13-word windows are hashed and sent with the smallest
   ``doc_id`` that has them; the answer is the smallest ``doc_id`` anywhere.
3. A window whose first holder has a smaller ``doc_id`` covers its words; these go.

Keys are distinct per chunk before they travel, so a passage that a third of all texts holds
is one entry a chunk.  No pairs are made.  Windows are compared by 64-bit hashes.

Edge cases: a null or blank text has no words; texts under 13 words lose nothing; a null
``doc_id`` sorts before all others; rows with equal ids never remove from one another; an
empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm import exchange as ex
from glyphmill.llm import textbytes as tb
from glyphmill.llm.common import save, text_bytes

WIDTH = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WIDTH - PERIOD + 1
ANCHORS, WINDOWS = 1, 2


class Words:
    """A chunk's word hashes: of which text each is and where in it."""

    def __init__(self, chunk: ex.Chunk):
        parts = [(lo, *tb.word_hashes(chunk.body, chunk.offs[lo: hi + 1], lower=False))
                 for lo, hi in tb.slices(chunk.offs)]
        self.n_texts = len(chunk.doc_id)
        self.hash = np.concatenate([h for _, h, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.text = np.concatenate([t + lo for lo, _, t in parts]) if parts else np.zeros(0, np.int64)
        self.count = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc_id = chunk.doc_id

    def starts(self, width: int) -> np.ndarray:
        """Flags of positions where ``width`` words of one text begin."""
        n = max(0, len(self.hash) - width + 1)
        return self.text[:n] == self.text[width - 1: width - 1 + n]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the anchors of texts that hold a full window."""
        at = np.arange(max(0, len(self.hash) - ANCHOR + 1))
        inside = (at - self.first[self.text[: len(at)]]) % PERIOD
        use = self.starts(ANCHOR) & np.isin(inside, COVER) & (self.count[self.text[: len(at)]] >= WIDTH)
        pos = np.flatnonzero(use)
        return pos, tb.windows(self.hash, ANCHOR)[pos]


def _sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, flags of group starts, group of each key in its own place)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, new, group


def _anchor_requests(chunk: ex.Chunk, buckets: int) -> Iterator[tuple]:
    words = Words(chunk)
    pos, keys = words.anchors()
    if not len(keys):
        return
    order, new, _ = _sorted_groups(keys)
    first = np.flatnonzero(new)
    doc_id = words.doc_id[words.text[pos]][order]
    docs = 1 + (np.minimum.reduceat(doc_id, first) != np.maximum.reduceat(doc_id, first))
    yield from ex.ask(chunk, ANCHORS, keys[order][first], [docs.astype(np.int64)], buckets)


def _window_keys(words: Words, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the full windows that hold a shared anchor; ``shared`` by anchor key."""
    pos, keys = words.anchors()
    _, _, group = _sorted_groups(keys)
    hit = np.zeros(len(words.hash) + 1, np.int64)
    hit[pos] = shared[group]
    total = np.concatenate([[0], np.cumsum(hit)])
    start = np.flatnonzero(words.starts(WIDTH))
    start = start[total[start + PERIOD] > total[start]]
    return start, (tb.windows(words.hash, WIDTH)[start] if len(start) else np.zeros(0, np.uint64))


def _window_requests(meeting: ex.Meeting, buckets: int) -> Iterator[tuple]:
    if ANCHORS not in meeting.answers:
        return
    words = Words(meeting.chunk)
    start, keys = _window_keys(words, meeting.answers[ANCHORS][0].view(np.int64))
    if not len(keys):
        return
    order, new, _ = _sorted_groups(keys)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(words.doc_id[words.text[start]][order], first)
    yield from ex.ask(meeting.chunk, WINDOWS, keys[order][first], [least], buckets)


def _combine(kind: int, first: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    if kind == ANCHORS:
        return [(np.add.reduceat(values[0], first) > 1).astype(np.int64)]
    return [np.minimum.reduceat(values[0], first)]


def _results(meetings: Iterator[ex.Meeting], with_text: bool) -> Iterator[pa.RecordBatch]:
    for m in meetings:
        words = Words(m.chunk)
        gone = np.zeros(len(words.hash), bool)
        if WINDOWS in m.answers:
            start, keys = _window_keys(words, m.answers[ANCHORS][0].view(np.int64))
            _, _, group = _sorted_groups(keys)
            least = m.answers[WINDOWS][0].view(np.int64)[group]
            bad = start[least < words.doc_id[words.text[start]]]
            edge = np.zeros(len(gone) + 1, np.int64)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + WIDTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
        removed = np.bincount(words.text, weights=gone, minlength=words.n_texts).astype(np.int64)
        raw, offs = m.chunk.body.tobytes(), m.chunk.offs.tolist()
        kept_sha, kept_text = [], []
        for i in range(words.n_texts):
            parts = raw[offs[i]: offs[i + 1]].split()
            if removed[i]:
                parts = compress(parts, (~gone[words.first[i]: words.first[i + 1]]).tolist())
            kept = b" ".join(parts)
            kept_sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode("utf-8", "replace"))
        cols = [tb.id_array(m.chunk.doc_id), pa.array(words.count), pa.array(removed), pa.array(kept_sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(kept_text, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    buckets, parts = ex.buckets_for(size), ex.partitions_for(docs, size)
    asked = docs.mapInArrow(
        lambda batches: ex.batched(r for c in ex.chunks(batches) for r in _anchor_requests(c, buckets)), ex.ROW)
    shared = save(ex.answer(asked, parts, _combine), "anchor-answers")
    states = ex.state(docs)
    asked = ex.meet(states, shared, parts, lambda ms: ex.batched(
        r for m in ms for r in _window_requests(m, buckets)), ex.ROW)
    least = save(ex.answer(asked, parts, _combine), "window-answers")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return ex.meet(states, shared.unionByName(least), parts, lambda ms: _results(ms, with_text), schema)
