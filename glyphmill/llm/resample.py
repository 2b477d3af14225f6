"""Target-distribution importance resampling, drawn by a distributed radix sort.

Every document is weighed by how much likelier its words are in the target texts than in the
corpus, over hashed buckets; a keyed Gumbel draw is added and the highest scores are taken::

    docs, target -> mapInArrow: words of a task -> counts of 10,000 buckets -> sum by bucket
    gains (one array of 10,000) -> mapInArrow: n_features and weight of every document
    score = weight + draw of (seed, doc_id)                                              [saved]
    eligible rows -> LSD radix sort by (score descending, doc_id, n_features)
    rank = place in that order, of the first share of the rows

The sort takes one stable counting pass a digit, least digit first.  A row has a place (block,
seat); a pass counts digits by block, adds the counts up over (digit, block) in levels of
bounded windows, and a row's next place is its (digit, block)'s offset plus its seat among the
block's rows of that digit.  A row moves once a pass, by (block, digit); a digit that all
rows share never gathers in one task, and digits that do not vary take no pass.

Defined cases: a null or empty text has no features, weight 0 and is never drawn.  Rows without a
``doc_id`` draw by the empty id and rank behind equal scores; rows equal in score and id rank by
fewer features.  Rows that share all three are alike, and which gets which rank does not show.
Without target texts (or documents) the gains follow from zero counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb
from glyphmill.llm.common import drop_saved, save

BUCKETS = 10_000
RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000

DIGIT_BITS = 11
#: Rows of a block, and blocks that one window adds up.
BLOCK = 1 << 13
LEVEL = 1 << 13

#: Word bytes keep their value (A-Z lower-cased), all others become spaces.
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x30:0x3A] = np.arange(0x30, 0x3A)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def word_buckets(texts: pa.Array, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every run of 1 to ``run`` consecutive words; buckets are hashed once a distinct word."""
    body, offs = tb.column(texts)
    clean = _CLEAN[body[offs[0]: offs[-1]]]
    plain = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer((offs - offs[0]).astype(np.int64)), pa.py_buffer(clean))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    row, flat = row[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    rows, found = [], []
    for k in range(1, run + 1):
        if len(flat) < k:
            break
        joined = flat
        if k > 1:
            joined = pc.binary_join_element_wise(*[flat.slice(i, len(flat) - k + 1) for i in range(k)], pa.scalar(" ", flat.type))
        coded = joined.dictionary_encode()
        hashes = np.array([zlib.crc32(w.as_buffer()) % buckets for w in coded.dictionary], np.int64)
        whole = row[: len(row) - k + 1] == row[k - 1:]
        rows.append(row[: len(row) - k + 1][whole])
        found.append(hashes[coded.indices.to_numpy()][whole])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; a task sends at most one row a bucket."""
    def fn(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            text = batch.column("text")
            _, offs = tb.column(text)
            for lo, hi in tb.slices(offs, 4 * tb.SLICE):
                _, found = word_buckets(text.slice(lo, hi - lo), run, buckets)
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(fn, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: an array of the fixed length ``buckets``."""
    counts = []
    for texts in (docs, target):
        found = np.zeros(buckets)
        for bucket, n in bucket_counts(texts, run, buckets).collect():      # at most ``buckets`` rows
            found[bucket] = n
        counts.append(found)
    s, t = counts
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))))


def weigh(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, n_features, weight): array scores of every document, one map pass."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            _, offs = tb.column(text)
            for lo, hi in tb.slices(offs, 4 * tb.SLICE):
                row, found = word_buckets(text.slice(lo, hi - lo), run, len(gain))
                n = np.bincount(row, minlength=hi - lo)
                weight = np.bincount(row, weights=gain[found], minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(weight)],
                                                 names=["doc_id", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(fn, "doc_id long, n_features long, weight long")


def draw(seed: int) -> Column:
    """A Gumbel draw in thousandths, from the first 32 bits of sha256(``seed:doc_id``)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# ---------------------------------------------------------------------------
# Distributed LSD radix sort

def _digits(key: Column, bits: int = DIGIT_BITS) -> list[Column]:
    """A 64-bit key's digits, least first (the key is read as unsigned)."""
    return [F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << min(bits, 64 - s)) - 1)).cast("int")
            for s in range(0, 64, bits)]


def _unsigned(column: str) -> Column:
    """A signed long whose unsigned order is the column's order."""
    return F.col(column).bitwiseXOR(F.lit(-(1 << 63)))


def _running(keys: list[str], by: list[str]) -> Column:
    before = Window.partitionBy(*keys) if keys else Window
    return F.coalesce(F.sum("n").over(before.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _offsets(counts: DataFrame) -> DataFrame:
    """(block, digit, offset) from (block, digit, n): exclusive sums in (digit, block) order.

    Two levels: LEVEL blocks of a digit are added up in a window of their own; the last window has
    a row for each digit and group of LEVEL blocks (67 million rows of input).
    """
    counts = counts.withColumn("group", F.floor(F.col("block") / LEVEL))
    groups = counts.groupBy("digit", "group").agg(F.sum("n").alias("n"))
    base = groups.select("digit", "group", _running([], ["digit", "group"]).alias("_base"))
    inner = counts.select("digit", "group", "block", _running(["digit", "group"], ["block"]).alias("_inner"))
    return inner.join(base, ["digit", "group"]).select("block", "digit", (F.col("_base") + F.col("_inner")).alias("offset"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with (block, seat), saved: a scan partition's rows fill blocks of their own, numbered without gaps."""
    at = F.monotonically_increasing_id()
    found = save(rows.withColumn("_part", F.shiftright(at, 33)).withColumn("_nth", at % F.lit(1 << 33)), "radix-parts")
    # one row a scan partition
    sizes = found.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"))
    base = sizes.select("_part", _running([], ["_part"]).alias("_base"))
    return save(found.join(base, "_part").select(
        *rows.columns, (F.col("_base") + F.floor(F.col("_nth") / BLOCK)).cast("long").alias("block"),
        (F.col("_nth") % BLOCK).cast("long").alias("seat")), "radix")


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable pass: the rows' next places; ``rows`` is a saved table with (block, seat)."""
    keyed = rows.withColumn("digit", digit)
    offsets = _offsets(keyed.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")))
    seat = F.row_number().over(Window.partitionBy("block", "digit").orderBy("seat")) - 1
    moved = keyed.withColumn("_nth", seat).join(offsets, ["block", "digit"])
    to = F.col("offset") + F.col("_nth")
    return moved.select(*[c for c in rows.columns if c not in ("block", "seat")],
                        F.floor(to / BLOCK).cast("long").alias("block"), (to % BLOCK).cast("long").alias("seat"))


def radix_sort(rows: DataFrame, key: list[Column]) -> DataFrame:
    """``rows`` with ``place``, their place 0, 1, 2... by the composite ``key`` (first column first).

    ``rows`` is a saved table; key columns are longs read as unsigned.  Rows equal in the key
    keep the order of the scan.
    """
    plain = rows.columns
    now = _numbered(rows)
    digits = [d for k in reversed(key) for d in _digits(k)]
    spread = now.agg(*[F.min(d).alias(f"a{i}") for i, d in enumerate(digits)],
                     *[F.max(d).alias(f"z{i}") for i, d in enumerate(digits)]).first()
    passes = [d for i, d in enumerate(digits) if spread[f"a{i}"] != spread[f"z{i}"]]
    for digit in passes or [F.lit(0)]:
        done = save(counting_pass(now, digit), "radix")
        drop_saved(now)
        now = done
    return now.select(*plain, (F.col("block") * BLOCK + F.col("seat")).alias("place"))


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    weighed = weigh(docs, gains(docs, target, run, buckets), run)
    scored = save(weighed.withColumn("score", F.col("weight") + draw(seed)), "scores")
    eligible = F.col("n_features") >= min_words
    n, top = scored.filter(eligible).agg(F.count(F.lit(1)), F.max("score")).first()
    drawn = percent * n // 100
    key = [F.lit(top).cast("long") - F.col("score"), F.col("doc_id").isNull().cast("long"),
           F.coalesce(_unsigned("doc_id"), F.lit(0).cast("long")), F.col("n_features")]
    placed = radix_sort(scored.filter(eligible), key)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank).unionByName(
        scored.filter(~eligible).select(*out, F.lit(None).cast("long").alias("rank")))
