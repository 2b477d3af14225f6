"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

A text is the set of its byte n-grams of length 1 to 4 (lower-cased, hashed into ``DIM``
cells).  The blended-spectrum presence kernel of two texts is the size of their common set
over the geometric mean of both sizes.  ``fit`` draws a bounded sample of labelled rows
(about ``PER_LANG`` a language, spread by hash), picks ``LANDMARKS`` of them, and solves one
ridge regression against the rest per language on the Nystroem map.  ``predict`` scores
every whole text: presence rows times the landmark matrix, times the dual weights, in
batches.  Only the model (landmarks and weights, a fixed size) is broadcast.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text
when no labelled row exists; ties go to the language first in code-point order; rows with a
null ``lang`` are never learned from; a null ``doc_id`` is kept; repeated rows get equal
results; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb

DIM = 1 << 14
MAX_GRAM = 4
#: Bounds of the fitting sample: rows a language (expected) and landmarks in all.
PER_LANG = 400
LANDMARKS = 96
RIDGE = 1e-3
SEED = 5
UNKNOWN = "und"

_GRAM_KEY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def presence(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 0/1 row a text: which n-gram cells the whole text touches."""
    lo = int(offs[0])
    part = tb.LOWER[body[lo: int(offs[-1])]].astype(np.uint32)
    out = np.zeros((len(offs) - 1, DIM), np.uint8)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int64) * DIM, np.diff(offs))
    left = np.repeat(offs[1:] - lo, np.diff(offs)) - np.arange(len(part))  # bytes to the text's end
    gram = np.zeros(len(part), np.uint32)
    for n in range(1, MAX_GRAM + 1):
        k = len(part) - n + 1
        if k <= 0:
            break
        gram = gram[:k] | (part[n - 1:] << np.uint32(8 * (n - 1)))
        cell = ((gram ^ (gram >> np.uint32(15))) * _GRAM_KEY[n - 1] + _GRAM_KEY[n - 1]) >> np.uint32(18)
        inside = left[:k] >= n
        flat[(row[:k] + cell)[inside]] = 1
    return out


def has_letter(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    lo, hi = int(offs[0]), int(offs[-1])
    part = body[lo:hi]
    seen = np.concatenate([[0], np.cumsum(_LETTER[part])])
    out = seen[offs[1:] - lo] > seen[offs[:-1] - lo]
    high = np.concatenate([[0], np.cumsum(part >= 128)])
    for i in np.flatnonzero(~out & (high[offs[1:] - lo] > high[offs[:-1] - lo])).tolist():
        out[i] = any(c.isalpha() for c in body[offs[i]: offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common cells over the geometric mean of both set sizes."""
    x, y = a.astype(np.float32), b.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(y.sum(1), 1))[None, :]
    return (x @ y.T) / norm


class Model:
    """Landmark rows (scaled by their norm) and dual weights a language."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, dual: np.ndarray, bias: np.ndarray):
        self.langs, self.dual, self.bias = langs, dual.astype(np.float32), bias.astype(np.float32)
        z = landmarks.astype(np.float32)
        self.columns = (z / np.sqrt(np.maximum(z.sum(1), 1))[:, None]).T.copy()

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        k = (x @ self.columns) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        return k @ self.dual + self.bias


def solve(rows: np.ndarray, labels: np.ndarray, langs: list[str], landmarks: int = LANDMARKS,
          ridge: float = RIDGE) -> Model:
    """Nystroem features from the first rows of each language, then ridge one-versus-rest."""
    y = np.array([langs.index(x) for x in labels])
    turn = np.zeros(len(y), np.int64)
    for c in range(len(langs)):
        turn[y == c] = np.arange((y == c).sum())
    pick = np.lexsort((y, turn))[:landmarks]
    z = rows[pick]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(rows, z).astype(np.float64) @ root
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.where(y[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    weight = 1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1)[y]
    gram = (phi1 * weight[:, None]).T @ phi1
    penalty = np.eye(len(gram)) * ridge
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(gram + penalty, (phi1 * weight[:, None]).T @ target)
    return Model(langs, z, root @ w[:-1], w[-1])


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, landmarks: int = LANDMARKS,
        seed: int = SEED) -> Model | None:
    """Fit on a sample of the rows where ``learn`` holds and ``lang`` and ``text`` are not null."""
    rows = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offs = tb.column(batch.column("text"))
            for lo, hi in tb.slices(offs):
                good = has_letter(body, offs[lo: hi + 1])
                bits = np.packbits(presence(body, offs[lo: hi + 1]), axis=1)
                lang = batch.column("lang").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), lang,
                     pa.array([b.tobytes() if g else None for b, g in zip(bits, good, strict=True)], pa.binary())],
                    names=["doc_id", "lang", "bits"])

    got = (rows.filter((unit < share) & F.col("text").isNotNull())
           .mapInArrow(fn, "doc_id long, lang string, bits binary").filter("bits IS NOT NULL").collect())
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["bits"]))
    order = np.random.default_rng(seed).permutation(len(got))
    got = [got[i] for i in order]
    bits = np.unpackbits(np.stack([np.frombuffer(r["bits"], np.uint8) for r in got]), axis=1)
    langs = sorted({r["lang"] for r in got})
    return solve(bits, np.array([r["lang"] for r in got], object), langs, landmarks)


def _labels(m: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, or one past the last for none; score) of a batch's texts."""
    body, offs = tb.column(batch.column("text"))
    best, score = np.full(len(offs) - 1, len(m.langs)), np.zeros(len(offs) - 1)
    for lo, hi in tb.slices(offs, tb.SLICE):
        for a in range(lo, hi, 256):  # rows of one matrix product
            b = min(a + 256, hi)
            s = m.scores(presence(body, offs[a: b + 1]))
            good = has_letter(body, offs[a: b + 1])
            best[a:b] = np.where(good, s.argmax(1), len(m.langs))
            score[a:b] = np.where(good, np.clip((s.max(1) + 1) / 2, 0, 1), 0.0)
    return best, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            best, score = _labels(m, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(names[best], pa.string()),
                 pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(fn, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language; one pass, no join.

    Only texts that ``predict`` calls UNKNOWN go; without a model, those without a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None:
                body, offs = tb.column(batch.column("text"))
                good = np.zeros(len(offs) - 1, bool)
                for lo, hi in tb.slices(offs, tb.SLICE):
                    good[lo:hi] = has_letter(body, offs[lo: hi + 1])
                yield batch.filter(pa.array(good))
            else:
                yield batch.filter(pa.array(_labels(m, batch)[0] < len(m.langs)))

    return docs.mapInArrow(fn, docs.schema)
