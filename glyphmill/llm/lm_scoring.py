"""Word bigram model by deleted interpolation, scored over whole texts.

Maximum-likelihood estimates of the bigram, the unigram and the uniform distribution are mixed;
the weights depend on how often the context was seen (buckets of powers of two).  They
are learned by expectation-maximisation on held-out counts: the documents of one fold of the
training part, under counts of the other folds.  The final model counts the whole training part.

Counts cover all training documents and travel as packed, distinct keys per chunk; each chunk
gets the counts of its own keys back, so hot words cost one entry a chunk.  What meets them is not
the texts but their tokens' places among the chunk's keys.  The expectation step needs only a histogram of (bucket, bigram estimate, unigram estimate) in eighths of an
octave, which has a bounded number of cells.

Tokens: words of the text with A-Z lower-cased, then one end.  A document's first context is
a start mark, which is no token.  Words are told apart by 64-bit hashes.

Edge cases: a null or blank text is the end alone; a null ``doc_id`` has the remainder of
the empty text; without training documents every token is unknown and the model is uniform;
repeated rows each count and are each scored; other columns of the input are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import exchange as ex
from glyphmill.llm import textbytes as tb
from glyphmill.llm.common import save, text_bytes

MODULUS, HELD_OUT, FOLD = 7, 2, 5
UNIGRAM, BIGRAM = 1, 2
END, START = np.uint64(0xE17D_0000_0000_0001), np.uint64(0x57A2_7000_0000_0001)
BUCKETS = 64
STEPS = 8  # histogram cells an octave
EM_ROUNDS = 40


class Tokens:
    """A chunk's tokens with their contexts, and each text's remainder."""

    def __init__(self, chunk: ex.Chunk):
        parts = [(lo, *tb.word_hashes(chunk.body, chunk.offs[lo: hi + 1], lower=True))
                 for lo, hi in tb.slices(chunk.offs)]
        words = np.concatenate([h for _, h, _ in parts])
        text = np.concatenate([t + lo for lo, _, t in parts])
        n = len(chunk.doc_id)
        ends = np.cumsum(np.bincount(text, minlength=n))
        self.token = np.insert(words, ends, END)
        self.text = np.insert(text, ends, np.arange(n))
        self.context = np.concatenate([[START], self.token[:-1]])
        self.context[np.concatenate([[0], ends[:-1] + np.arange(1, n)])] = START
        self.pair = tb.mix(self.context * np.uint64(0x9E3779B97F4A7C15) + self.token)
        self.rest = np.array([zlib.crc32(b"" if d == tb.NO_ID else str(d).encode()) % MODULUS
                              for d in chunk.doc_id.tolist()])
        self.doc_id, self.n_texts = chunk.doc_id, n

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, text): every token, and each text's start mark."""
        return (np.concatenate([self.token, np.full(self.n_texts, START)]),
                np.concatenate([self.text, np.arange(self.n_texts)]))


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, place): a sorting order, where distinct keys begin in it, each key's rank among these."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def _requests(chunk: ex.Chunk, buckets: int) -> Iterator[tuple]:
    t = Tokens(chunk)
    for kind, (keys, text) in ((UNIGRAM, t.unigrams()), (BIGRAM, (t.pair, t.text))):
        order, first, _ = ranks(keys)
        rest = t.rest[text[order]]
        train = np.add.reduceat((rest != HELD_OUT).astype(np.int64), first)
        fold = np.add.reduceat((rest == FOLD).astype(np.int64), first)
        yield from ex.ask(chunk, kind, keys[order][first], [train, fold], buckets)


class Places:
    """A chunk's texts as places in its requests: tokens and pairs by their rank among the chunk's keys.

    This meets the answers in the texts' stead, so that nothing is split, hashed or looked up again.
    """

    def __init__(self, doc_id: np.ndarray, rest: np.ndarray, sizes: np.ndarray,
                 token: np.ndarray, pair: np.ndarray, start: int):
        self.doc_id, self.rest, self.sizes, self.token, self.pair, self.start = doc_id, rest, sizes, token, pair, start

    @classmethod
    def of(cls, chunk: ex.Chunk, fold_only: bool) -> Places:
        t = Tokens(chunk)
        texts = t.rest == FOLD if fold_only else np.ones(t.n_texts, bool)
        token, pair, start = t.token[:0].view(np.int64), t.pair[:0].view(np.int64), 0
        if texts.any():
            uni, mine = ranks(t.unigrams()[0])[2], texts[t.text]
            token, pair, start = uni[: len(t.token)][mine], ranks(t.pair)[2][mine], int(uni[-1])
        sizes = np.bincount(t.text, minlength=t.n_texts)[texts]
        return cls(t.doc_id[texts], t.rest[texts], sizes, token, pair, start)

    def packed(self) -> bytes:
        rows = (self.doc_id, self.rest, self.sizes, self.token, self.pair, np.array([self.start]))
        return ex.join_parts([ex.pack(r.astype(np.int64, copy=False).view(np.uint64)) for r in rows])

    @classmethod
    def unpacked(cls, number: int, data: bytes) -> Places:
        *rows, start = (ex.unpack(p).view(np.int64) for p in ex.split_parts(data))
        return cls(*rows, int(start[0]))

    def counts(self, tokens: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of token, of context, of pair) at every token, from counts in key order."""
        context = np.concatenate([[self.start], self.token[:-1]])
        context[np.cumsum(self.sizes) - self.sizes] = self.start
        return tokens[self.token], tokens[context], pairs[self.pair]


def _totals(kind: int, first: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    return [np.add.reduceat(v, first) for v in values]


def _figures(kind: int, keys: np.ndarray, totals: list[np.ndarray]) -> bytes:
    """Tokens and distinct tokens of the training part, and of it without the fold."""
    if kind != UNIGRAM:
        return np.zeros(4, np.int64).tobytes()
    real = keys != START
    train, kept = totals[0][real], (totals[0] - totals[1])[real]
    return np.array([train.sum(), (train > 0).sum(), kept.sum(), (kept > 0).sum()], np.int64).tobytes()


def _sum_figures(answers: DataFrame) -> tuple[int, int, int, int]:
    def fn(batches):
        for b in batches:
            rows = [np.frombuffer(x, np.int64) for x in b.column("data").to_pylist()]
            total = np.sum(rows, axis=0) if rows else np.zeros(4, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in total], names=["a", "b", "c", "d"])
    r = (answers.filter("chunk = -1").select("data").mapInArrow(fn, "a long, b long, c long, d long")
         .agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "abcd"]).first())
    return tuple(int(x) for x in r)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)  # 0 for none, else floor(log2) + 1


def _ratio(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return a / np.maximum(b, 1)


def _cells(meetings: Iterator[ex.Meeting], n_kept: int) -> Iterator[pa.RecordBatch]:
    """The fold's tokens under the other folds' counts, as histogram cells."""
    for m in meetings:
        if not len(m.chunk.doc_id):
            continue
        c, v, p = m.chunk.counts(*(np.subtract(*(x.view(np.int64) for x in m.answers[k])) for k in (UNIGRAM, BIGRAM)))

        def cell(f):
            out = np.zeros(len(f), np.int64)
            out[f > 0] = 1 + np.round(-np.log2(f[f > 0]) * STEPS).astype(np.int64)
            return out
        code = (bucket(v) << 40) | (cell(_ratio(p, v)) << 20) | cell(_ratio(c, n_kept))
        code, n = np.unique(code, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def learn_weights(cells: dict[int, int], n_types: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform by expectation-maximisation."""
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    out[0] = [0.0, 0.7, 0.3]
    code = np.array(sorted(cells), np.int64)
    n = np.array([cells[c] for c in code.tolist()], np.float64)
    back = lambda q: np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0.0)
    b, f2, f1 = code >> 40, back((code >> 20) & 0xFFFFF), back(code & 0xFFFFF)
    seen = []
    for k in np.unique(b).tolist():
        here = b == k
        est = np.stack([f2[here] if k else np.zeros(here.sum()), f1[here], np.full(here.sum(), 1 / (n_types + 1))])
        w = out[k]
        for _ in range(rounds):
            part = w[:, None] * est
            part = part / np.maximum(part.sum(0), 1e-300) * n[here]
            w = (part.sum(1) + 1e-3 * (out[k] > 0)) / (part.sum() + 1e-3 * (out[k] > 0).sum())
        out[k] = w
        seen.append(k)
    for k in range(1, BUCKETS):  # a frequency that the fold never showed takes the next lower one's
        lower = [s for s in seen if 0 < s <= k]
        if k not in seen and lower:
            out[k] = out[lower[-1]]
    return out


def _scores(meetings: Iterator[ex.Meeting], weights: np.ndarray, n: int, v: int) -> Iterator[pa.RecordBatch]:
    for m in meetings:
        t = m.chunk
        c, context, pair = t.counts(*(m.answers[k][0].view(np.int64) for k in (UNIGRAM, BIGRAM)))
        w = weights[bucket(context)]
        p = w[:, 0] * _ratio(pair, context) + w[:, 1] * _ratio(c, n) + w[:, 2] / (v + 1)
        if not n:
            p = np.ones(len(c))
        text = np.repeat(np.arange(len(t.sizes)), t.sizes)
        per_text = lambda x: np.bincount(text, weights=x, minlength=len(t.sizes))
        yield pa.RecordBatch.from_arrays(
            [tb.id_array(t.doc_id), pa.array(t.rest == HELD_OUT), pa.array(t.sizes),
             pa.array(per_text(c > 0).astype(np.int64)), pa.array(np.full(len(t.sizes), n, np.int64)),
             pa.array(per_text(np.log10((c + 1) / (n + v + 1)))), pa.array(per_text(np.log10(p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    buckets, parts = ex.buckets_for(size), ex.partitions_for(docs, size)
    asked = docs.mapInArrow(
        lambda batches: ex.batched(r for c in ex.chunks(batches) for r in _requests(c, buckets)), ex.ROW)
    counts = save(ex.answer(asked, parts, _totals, _figures), "ngram-counts")
    n, v, n_kept, _ = _sum_figures(counts)
    fold, every = (ex.state(docs, lambda c, only=only: Places.of(c, only).packed()) for only in (True, False))
    cells = ex.meet(fold, counts, parts, lambda ms: _cells(ms, n_kept), "code long, n long", Places.unpacked)
    # bounded: buckets x estimates in eighths of an octave
    weights = learn_weights({r["code"]: r["n"] for r in cells.groupBy("code").agg(F.sum("n").alias("n")).collect()}, v)
    return ex.meet(every, counts, parts, lambda ms: _scores(ms, weights, n, v),
                   "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                   "base_score double, score double", Places.unpacked)
