"""Repeated 50-byte strings by a sparse, range-partitioned suffix array.

Suffixes are kept where a text's minimizer stands: of the ``GRAM``-byte strings inside each
50-byte window, the one with the smallest hash (leftmost of equals).  Equal windows have it at
the same offset, so each window belongs to one such suffix, and a window repeats exactly when
its suffix and the bytes before it do.

1. Chunks learn which minimizer strings another document has too; other suffixes go no further.
2. Each remaining suffix, its next 50 bytes and the few before it, goes to the bucket that
   sampled splitters give for its leading ``GRAM`` bytes.  Equal leading bytes never straddle a
   boundary, and windows of a suffix share at least those, so buckets need no exchange at their edges.
3. A bucket sorts its suffixes by multikey quicksort (a word of eight bytes at a time, only ties
   go on), and the bytes before them likewise, backwards.  Neighbours' common lengths give, for
   each offset, the groups of equal windows and the smallest ``doc_id`` of each.
4. Chunks get these back and drop every byte of windows whose first holder is smaller.

Suffixes with equal surroundings are sent once a chunk, so a passage that a third of all
texts holds is a few entries a chunk; no pairs are made.

Edge cases: a null text is empty; texts under 50 bytes lose nothing; matches never cross
documents; a null ``doc_id`` sorts before all others; rows with equal ids never remove from
one another; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import exchange as ex
from glyphmill.llm import textbytes as tb
from glyphmill.llm.common import save, text_bytes

WIDTH = 50
GRAM = 28
SPAN = WIDTH - GRAM + 1          # minimizer candidates of a window
BEFORE = SPAN - 1                # bytes before a suffix that its windows can hold
GRAMS, SUFFIXES = 1, 2
#: Sampled leading strings per bucket, from which the splitters are taken.
SAMPLES = 32


def sliding_first_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    got, now = 1, keys
    while 2 * got <= width:
        now = np.minimum(now[:-got], now[got:])
        got *= 2
    if got < width:
        now = np.minimum(now[: len(now) - (width - got)], now[width - got:])
    return now


def minimizers(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, smallest offset, largest offset, text, gram hash, context hash) of each suffix kept."""
    lo, n = int(offs[0]), int(offs[-1] - offs[0])
    ends = offs[1:] - lo
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = tb.running(tb.BYTE_WORD[body[lo: lo + n]])
    at = np.arange(n - GRAM + 1)
    gram = tb.span_hash(prefix, at, at + GRAM)
    key = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    where = (sliding_first_min(key, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end_of = np.repeat(ends, np.diff(offs))
    window = np.flatnonzero(np.arange(len(where)) + WIDTH <= end_of[: len(where)])
    if not len(window):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    pos = where[window]
    new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.concatenate([new[1:], [len(pos)]]) - 1
    a = pos[new]
    most, least = a - window[new], a - window[last]
    text = np.searchsorted(ends, a, side="right")
    begin = np.maximum(a - BEFORE, (offs[:-1] - lo)[text])
    stop = np.minimum(a + WIDTH, ends[text])
    shape = ((a - begin) << 24 | (stop - a) << 16 | least << 8 | most).astype(np.uint64)
    context = tb.mix(tb.span_hash(prefix, begin, stop) + shape * np.uint64(0x9E3779B97F4A7C15))
    return a, least, most, text, gram[a], context


class Suffixes:
    """A chunk's kept suffixes, positions counted in the chunk's bytes."""

    def __init__(self, chunk: ex.Chunk):
        self.chunk = chunk
        parts = []
        for lo, hi in tb.slices(chunk.offs):
            a, least, most, text, gram, context = minimizers(chunk.body, chunk.offs[lo: hi + 1])
            parts.append((a + chunk.offs[lo], least, most, text + lo, gram, context))
        self.pos, self.least, self.most, self.text, self.gram, self.context = (
            np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = chunk.doc_id[self.text]

    def pick(self, use: np.ndarray) -> None:
        for name in ("pos", "least", "most", "text", "gram", "context", "doc"):
            setattr(self, name, getattr(self, name)[use])

    def surroundings(self, rows: np.ndarray) -> np.ndarray:
        """(rows, BEFORE + WIDTH) bytes around each suffix, zero outside its text."""
        body, offs = self.chunk.body, self.chunk.offs
        out = np.zeros((len(rows), BEFORE + WIDTH), np.uint8)
        for lo in range(0, len(rows), 1 << 15):  # bounds the index arrays
            some = rows[lo: lo + (1 << 15)]
            at = self.pos[some][:, None] + np.arange(-BEFORE, WIDTH)[None, :]
            inside = (at >= offs[self.text[some]][:, None]) & (at < offs[self.text[some] + 1][:, None])
            out[lo: lo + (1 << 15)][inside] = body[at[inside]]
        return out


def _gram_requests(chunk: ex.Chunk, buckets: int) -> Iterator[tuple]:
    s = Suffixes(chunk)
    if not len(s.gram):
        return
    order = np.argsort(s.gram, kind="stable")
    ranked, doc = s.gram[order], s.doc[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    yield from ex.ask(chunk, GRAMS, ranked[first], [1 + several.astype(np.int64)], buckets)


def _shared(kind: int, first: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    return [(np.add.reduceat(values[0], first) > 1).astype(np.int64)]


def _distinct(s: Suffixes, shared: np.ndarray, splitters: np.ndarray):
    """Keep shared suffixes; (first row of each distinct surrounding in bucket order, their
    buckets, surroundings, and each suffix's place in that order)."""
    _, place = np.unique(s.gram, return_inverse=True)
    s.pick(shared[place] > 0)
    _, first, group = np.unique(s.context, return_index=True, return_inverse=True)
    around = s.surroundings(first)
    lead = np.ascontiguousarray(around[:, BEFORE: BEFORE + GRAM]).view(f"S{GRAM}").reshape(-1)
    bucket = np.searchsorted(splitters, lead, side="right") if len(splitters) else np.zeros(len(lead), np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return first[order], bucket[order], around[order], rank[group]


def _suffix_requests(m: ex.Meeting, splitters: np.ndarray) -> Iterator[tuple]:
    if GRAMS not in m.answers:
        return
    s = Suffixes(m.chunk)
    first, bucket, around, place = _distinct(s, m.answers[GRAMS][0].view(np.int64), splitters)
    if not len(first):
        return
    least_doc = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least_doc, place, s.doc)
    mark = np.int64(m.chunk.digest()).tobytes()
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    zip_ = zstandard.ZstdCompressor(level=3)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = first[a:b]
        yield m.chunk.number, SUFFIXES, int(bucket[a]), ex.join_parts([
            mark, ex.pack(least_doc[a:b]), ex.pack(s.least[rows]), ex.pack(s.most[rows]),
            zip_.compress(np.ascontiguousarray(around[a:b]).tobytes())])


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common length of each sorted row with the one before it) of byte rows.

    Sorts by eight bytes at a time; only rows still tied with a neighbour take the next word.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    value = words[order, 0]
    group = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]).astype(np.int64))
    for k in range(1, words.shape[1]):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub = order[tied]
        again = np.lexsort((words[sub, k], group[tied]))
        order[tied] = sub[again]
        value = words[order, k]
        same = (group[1:] == group[:-1]) & (value[1:] == value[:-1])
        group = np.cumsum(np.concatenate([[0], ~same]).astype(np.int64))
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[0], common])


def first_holders(around: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(rows, SPAN) smallest doc of each suffix's window at each offset (its own doc where it has none)."""
    n = len(around)
    after, lcp = multikey_sort(around[:, BEFORE:])
    before, lcs = multikey_sort(around[:, BEFORE - 1:: -1] if BEFORE else around[:, :0])
    out = np.repeat(doc[:, None], SPAN, axis=1)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SPAN):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if not len(rows):
            continue
        right[after] = np.cumsum(lcp < WIDTH - o)
        left[before] = np.cumsum(lcs < o)
        key = right[rows] * (n + 1) + left[rows]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        low = np.minimum.reduceat(doc[rows][order], np.flatnonzero(new))
        out[rows[order], o] = low[np.cumsum(new) - 1]
    return out


def _solve(kind: int, bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    parts = [ex.split_parts(r[1]) for r in rows]
    doc, least, most = (np.concatenate([ex.unpack(p[i]).view(np.int64) for p in parts]) for i in (1, 2, 3))
    unzip = zstandard.ZstdDecompressor()
    around = np.concatenate([np.frombuffer(unzip.decompress(p[4]), np.uint8) for p in parts]).reshape(-1, BEFORE + WIDTH)
    holder = first_holders(around, least, most, doc)
    used = (np.arange(SPAN)[None, :] >= least[:, None]) & (np.arange(SPAN)[None, :] <= most[:, None])
    lo = 0
    for (chunk, _), p in zip(rows, parts, strict=True):
        hi = lo + len(ex.unpack(p[1]))
        flat = holder[lo:hi][used[lo:hi]]
        yield chunk, kind, bucket, ex.join_parts([p[0], ex.pack(flat)])
        lo = hi


def _results(meetings: Iterator[ex.Meeting], splitters: np.ndarray, with_text: bool) -> Iterator[pa.RecordBatch]:
    for m in meetings:
        offs, body = m.chunk.offs, m.chunk.body
        edge = np.zeros(len(body) + 1, np.int32)
        if SUFFIXES in m.answers:
            s = Suffixes(m.chunk)
            first, _, _, place = _distinct(s, m.answers[GRAMS][0].view(np.int64), splitters)
            least, most = s.least[first], s.most[first]
            holder = m.answers[SUFFIXES][0].view(np.int64)
            begin = np.concatenate([[0], np.cumsum(most - least + 1)])
            for o in range(SPAN):
                rows = np.flatnonzero((s.least <= o) & (o <= s.most))
                low = holder[begin[place[rows]] + o - s.least[rows]]
                start = s.pos[rows[low < s.doc[rows]]] - o
                np.add.at(edge, start, 1)
                np.add.at(edge, start + WIDTH, -1)
        gone = np.cumsum(edge, out=edge)[:-1] > 0
        del edge
        total = np.zeros(len(gone) + 1, np.int32)  # Arrow's string columns end at 2 GB
        np.cumsum(gone, out=total[1:])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offs[:-1][offs[:-1] < len(gone)]
        begins[heads] = gone[heads]
        spans = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(begins, out=spans[1:])
        sha, kept_text = [], []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            kept = (body[a:b] if total[a] == total[b] else body[a:b][~gone[a:b]]).tobytes()
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept)
        cols = [tb.id_array(m.chunk.doc_id), pa.array(np.diff(offs)), pa.array(np.diff(total[offs]).astype(np.int64)),
                pa.array(np.diff(spans[offs]).astype(np.int64)), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(kept_text, pa.binary())], [*names, "kept_bytes"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def sample_splitters(docs: DataFrame, buckets: int, size: int) -> np.ndarray:
    """Leading strings that cut the suffixes evenly, from about SAMPLES of them a bucket.

    They only balance buckets; results do not depend on them.
    """
    want = SAMPLES * buckets
    share = min(1.0, 4 * want / max(1, size * 2 // (SPAN + 1)))

    def fn(batches):
        for batch in batches:
            body, offs = tb.column(batch.column("text"))
            for lo, hi in tb.slices(offs):
                a, *_, gram, _ = minimizers(body, offs[lo: hi + 1])
                a = a[(gram & np.uint64(3)) == 0] + offs[lo]  # a quarter of the picked texts' suffixes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([body[p: p + GRAM].tobytes() for p in a.tolist()], pa.binary())], names=["lead"])
    unit = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    got = docs.filter(unit < share).select("doc_id", "text").mapInArrow(fn, "lead binary").collect()
    leads = np.sort(np.array([bytes(r["lead"]) for r in got], dtype=f"S{GRAM}"))
    if buckets < 2 or not len(leads):
        return np.zeros(0, f"S{GRAM}")
    return np.unique(leads[np.linspace(0, len(leads) - 1, buckets + 1).astype(int)[1:-1]])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) for every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    buckets, parts = ex.buckets_for(size), ex.partitions_for(docs, size)
    splitters = sample_splitters(docs, buckets, size)
    asked = docs.mapInArrow(
        lambda batches: ex.batched(r for c in ex.chunks(batches) for r in _gram_requests(c, buckets)), ex.ROW)
    shared = save(ex.answer(asked, parts, _shared), "gram-answers")
    states = ex.state(docs)
    asked = ex.meet(states, shared, parts,
                    lambda ms: ex.batched(r for m in ms for r in _suffix_requests(m, splitters)), ex.ROW)
    holders = save(ex.solve_buckets(asked, parts, _solve), "suffix-answers")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return ex.meet(states, shared.unionByName(holders), parts,
                   lambda ms: _results(ms, splitters, with_text), schema)
