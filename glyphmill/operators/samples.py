"""Training-example construction over encoded documents.

Input is a ``(doc_id, tokens ARRAY<BIGINT>)`` table.  Everything is JVM-side:
windows come from ``sequence``/``slice``, random starts from a seeded md5 of
``(seed, doc_id, k)`` so the draw does not depend on partitioning or order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import char_codes
from glyphmill.operators import codec, packed
from glyphmill.session import cut_lineage, ensure_worker_import
from glyphmill.sources.corpus import read_corpus, seeded_hash_key, seeded_uint32

# Defaults of the reference trainer (fixed values).
SAMPLE_SIZE = 1_000
BATCH_SIZE = 10
N_SAMPLES = 1_000_000
RNG_SEED = 0xDEADBEEF


def windows_per_doc(n_tokens: Column, sample_size: int) -> Column:
    """``ceil(len / min(sample_size, len))``; 0 for an empty document."""
    sl = F.least(F.lit(sample_size), n_tokens)
    return F.when(n_tokens <= 0, F.lit(0)).otherwise(F.ceil(n_tokens / sl)).cast("int")


def sample_windows(encoded: DataFrame, sample_size: int = SAMPLE_SIZE, seed: int = RNG_SEED,
                   tokens_col: str = "tokens", keys: list[str] | None = None,
                   keep_short: bool = False) -> DataFrame:
    """One row per training window with its shifted (x, y) pair.

    ``start_idx`` is uniform in ``[0, len - sample_len)`` (0 when the window is the
    whole document), so windows may overlap and the last token of a long
    document is never covered -- as in the reference.  Windows of length 1 give
    an empty ``x`` and are dropped (L04) unless ``keep_short``.
    Output: ``keys, k, start_idx, sample_len, x, y``.
    """
    keys = keys or ["doc_id"]
    n = F.size(tokens_col)
    base = (encoded.select(*keys, tokens_col)
            .withColumn("_len", n)
            .withColumn("_nw", windows_per_doc(F.col("_len"), sample_size)))
    # explode_outer + a guarded sequence instead of filter + explode: a filter on
    # the token count (or the one Spark infers for explode) would be pushed into
    # the scan and recompute the token arrays there.
    ks = F.when(F.col("_nw") > 0, F.sequence(F.lit(0), F.col("_nw") - 1))
    wins = (base.select(*keys, tokens_col, "_len", F.explode_outer(ks).alias("k"))
            .filter(F.col("k").isNotNull()))
    sl = F.least(F.lit(sample_size), F.col("_len"))
    if not keep_short:
        # reads k as well, so that it stays above the explode; size(x) would cut every window twice
        wins = wins.filter(F.when(F.col("k") >= 0, sl > 1).otherwise(False))
    span = F.col("_len") - sl
    start = F.when(span <= 0, F.lit(0)).otherwise(
        F.pmod(seeded_uint32(seed, *keys, "k"), span)).cast("int")
    wins = wins.withColumn("sample_len", sl.cast("int")).withColumn("start_idx", start)
    return wins.select(
        *keys, F.col("k").cast("int").alias("k"), "start_idx", "sample_len",
        F.slice(tokens_col, F.col("start_idx") + 1, F.col("sample_len") - 1).alias("x"),
        F.slice(tokens_col, F.col("start_idx") + 2, F.col("sample_len") - 1).alias("y"))


def sample_summary(windows: DataFrame, n_samples: int = N_SAMPLES) -> DataFrame:
    """L04/L05 figures of all windows (``keep_short``): usable, dropped, and whether they run out."""
    return windows.agg(
        F.count(F.when(F.size("x") > 0, 1)).alias("n_samples"),
        F.count(F.when(F.size("x") == 0, 1)).alias("n_dropped"),
        (F.count(F.when(F.size("x") > 0, 1)) < n_samples).alias("short"))


def pair_counts(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of (current token, next token) pairs over all windows.

    Partial aggregation happens before the shuffle, so a hot pair (" ", "t") is
    one row per map task, not one per occurrence.
    """
    keys = keys or []
    pairs = samples.select(*keys, F.explode(F.arrays_zip("x", "y")).alias("p"))
    return (pairs.select(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
            .groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n")))


def window_pairs(samples: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """P06 of each window in its own row: ``x, y`` become its distinct pairs ``xs, ys`` and their counts ``ns``.

    All pairs of a window are in its row, so they are counted in the map task and nothing is shuffled.
    ``y`` is ``x`` a place on (L03), so only its last token travels with ``x``.  ``ids(code, tok_idx)`` turns codes into model ids (E06) on
    the way; a code without one is an error.  Other columns stay.
    """
    ensure_worker_import(samples.sparkSession)
    keep = [c for c in samples.columns if c not in ("x", "y")]
    known = None if ids is None else codec.broadcast_ids(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in codec._slices(batch, "x"):
                x, offs = packed.flat_lists(rows.column("x"))
                x, last = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (x, rows.column("_last").drop_null()))
                if known is not None:
                    x, last = codec.to_ids(x, known.value), codec.to_ids(last, known.value)
                y = np.append(x[1:], x[:1])
                y[offs[1:][np.diff(offs) > 0] - 1] = last
                row = np.repeat(np.arange(rows.num_rows), np.diff(offs))
                row, x, y, n = counted_pairs(x, y, np.ones(len(x), np.int64), row)
                ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [packed.list_column(v, ends) for v in (x, y, n)],
                                                 names=[*keep, "xs", "ys", "ns"])

    shifted = samples.select(*keep, "x", F.when(F.size("x") > 0, F.element_at("y", -1)).alias("_last"))
    return shifted.mapInArrow(run, codec._schema_with(samples, keep, "xs array<bigint>, ys array<bigint>, ns array<bigint>"))


def text_window_pairs(texts: DataFrame, ids: DataFrame, sample_size: int = SAMPLE_SIZE, seed: int = RNG_SEED,
                      text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """L01-L04 and P06 of character tokens: the rows of ``window_pairs(sample_windows(char_codes(text)), ids)``, whose lists are of 32 bits.

    The starts are drawn from the number of characters; texts travel as they are, once each, and are
    cut to windows where their pairs are counted, so no array of codes or windows is made on the way.
    """
    keys = keys or ["doc_id"]
    ensure_worker_import(texts.sparkSession)
    known = codec.broadcast_ids(ids)
    # the length is a column of its own: each draw reads it
    sized = texts.select(*keys, F.col(text_col).alias("_text"), F.length(text_col).alias("_n"))
    n = F.col("_n")
    sl = F.least(F.lit(sample_size), n)
    span = n - sl
    ks = F.when((n > 0) & (sl > 1), F.sequence(F.lit(0), windows_per_doc(n, sample_size) - 1))
    start = lambda k: F.when(span <= 0, F.lit(0)).otherwise(F.pmod(seeded_uint32(seed, *keys, k), span)).cast("int")
    rows = sized.select(*keys, "_text", sl.cast("int").alias("sample_len"), F.transform(ks, start).alias("_starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, idx = known.value
        place = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)     # of code points: 8 MB at most
        place[codes] = idx
        width = int(idx.max(initial=0)) + 1
        for batch in batches:
            some = pc.fill_null(pc.list_value_length(batch.column("_starts")), 0)
            for rows in _text_slices(batch.filter(pc.greater(some, 0))):
                flat, offs = packed.char_codes(rows.column("_text"))
                flat = place[np.minimum(flat, len(place) - 1)]
                if (flat < 0).any():
                    raise ValueError("token code without a model id")
                starts, ends = packed.flat_lists(rows.column("_starts"))
                starts = starts.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(rows.num_rows), np.diff(ends))
                k = np.arange(len(doc)) - ends[doc]
                size = rows.column("sample_len").to_numpy().astype(np.int64)[doc]
                for lo, hi in _runs(size, codec.SLICE_ELEMENTS):
                    x, y, n, at = _counted_windows(flat, offs[doc[lo: hi]] + starts[lo: hi], size[lo: hi] - 1, width)
                    own = pa.array(doc[lo: hi])
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c).take(own) for c in keys), pa.array(k[lo: hi].astype(np.int32)), pa.array(starts[lo: hi].astype(np.int32)),
                         pa.array(size[lo: hi].astype(np.int32)), *(packed.list_column(v.astype(np.int32), at) for v in (x, y, n))],
                        names=[*keys, "k", "start_idx", "sample_len", "xs", "ys", "ns"])

    return rows.mapInArrow(run, codec._schema_with(
        texts, keys, "k int, start_idx int, sample_len int, xs array<int>, ys array<int>, ns array<int>"))


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places (lo, hi) of neighbours whose sizes add up to ``most``, or of one that is larger."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some SLICE_ELEMENTS bytes of text."""
    for lo, hi in _runs(pc.binary_length(batch.column("_text")).to_numpy().astype(np.int64), 4 * codec.SLICE_ELEMENTS):
        yield batch.slice(lo, hi - lo)


def _counted_windows(flat: np.ndarray, start: np.ndarray, n_pairs: np.ndarray, width: int):
    """(x, y, n, offsets by window) of the distinct pairs of neighbours in windows of ``flat``, ids below ``width``."""
    ends = np.append(0, np.cumsum(n_pairs))
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], n_pairs)
    row = np.repeat(np.arange(len(start)), n_pairs)
    if len(start) * width * width >= 1 << 62:
        row, x, y, n = counted_pairs(flat[at], flat[at + 1], np.ones(len(at), np.int64), row)
        return x, y, n, np.searchsorted(row, np.arange(len(start) + 1))
    key = (row * width + flat[at]) * width + flat[at + 1]
    key = np.sort(key.astype(np.int32) if len(start) * width * width < 1 << 31 else key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n, key = np.diff(np.append(first, len(key))), key[first].astype(np.int64)
    pair = key % (width * width)
    return pair // width, pair % width, n, np.searchsorted(key // (width * width), np.arange(len(start) + 1))


def counted_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, row: np.ndarray | None = None):
    """(row, x, y, n) with the counts of equal (row, x, y) added up, in that order."""
    if not len(x):
        return np.zeros(0, np.int64), x, y, n
    row = np.zeros(len(x), np.int64) if row is None else row
    if max(x.max(), y.max()) < 1 << 21 and row[-1] < 1 << 20:      # all characters and 983,000 tokens: one sort
        key = row << 42 | x << 21 | y
        order = np.argsort(key) if n.max() > 1 else None
        key = np.sort(key) if order is None else key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(first, len(key))) if order is None else np.add.reduceat(n[order], first)
        key = key[first]
        return key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF, counts.astype(np.int64)
    pairs, at = np.unique(x << 32 | y, return_inverse=True)        # ids and codes are below 2**31
    found, back = np.unique(row * len(pairs) + at, return_inverse=True)
    pair = pairs[found % len(pairs)]
    return found // len(pairs), pair >> 32, pair & 0xFFFFFFFF, np.bincount(back, n).astype(np.int64)


def total_pairs(windows: DataFrame) -> DataFrame:
    """P06 over all rows of ``window_pairs``: ``(x, y, n)``, combined in the map task before the shuffle."""
    ensure_worker_import(windows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("xs", "ys", "ns"))
            _, x, y, n = counted_pairs(x, y, n)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n)], names=["x", "y", "n"])

    found = windows.select("xs", "ys", "ns").mapInArrow(run, "x bigint, y bigint, n bigint")
    return found.groupBy("x", "y").agg(F.sum("n").alias("n"))


def merged_pairs(per_sample: DataFrame, keys: list[str]) -> DataFrame:
    """Pair counts ``(keys, x, y, n)``, or rows of ``window_pairs``, as one row ``(keys, xs, ys, ns)`` a sample."""
    if "xs" in per_sample.columns:
        return per_sample.groupBy(*keys).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("xs", "ys", "ns")])
    found = per_sample.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "n")).alias("p"))
    return found.select(*keys, F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.n").alias("ns"))


def exploded_pairs(windows: DataFrame) -> DataFrame:
    """Rows of ``window_pairs`` as a row a pair: other columns, ``x, y, n``."""
    keep = [c for c in windows.columns if c not in ("xs", "ys", "ns")]
    rows = windows.select(*keep, F.explode(F.arrays_zip("xs", "ys", "ns")).alias("p"))
    return rows.select(*keep, F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), F.col("p.ns").alias("n"))


def global_index(df: DataFrame, order_cols: list[str], weight_col: str | None = None) -> DataFrame:
    """Exclusive running total of ``weight_col`` (or row count) in ``order_cols`` order.

    Two levels, never one global window: rows are range-partitioned by any orderable
    key (Spark samples the splits), partition totals -- one row a partition -- are
    prefix-summed, then a window per partition adds the running total inside it.
    Adds ``_offset`` (BIGINT).
    """
    w = F.col(weight_col) if weight_col else F.lit(1)
    ranged = cut_lineage(df.withColumn("_w", w.cast("bigint")).repartitionByRange(*order_cols)
                         .withColumn("_bucket", F.spark_partition_id()))
    totals = ranged.groupBy("_bucket").agg(F.sum("_w").alias("_bt"))
    # one row per partition: this window is over a bounded table
    offsets = totals.select(
        "_bucket",
        (F.sum("_bt").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_bt")).alias("_bo"))
    inner = Window.partitionBy("_bucket").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.withColumn("_lo", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    return (local.join(F.broadcast(offsets), "_bucket")
            .withColumn("_offset", (F.col("_bo") + F.col("_lo")).cast("bigint"))
            .drop("_bucket", "_w", "_bo", "_lo"))


def limit_samples(samples: DataFrame, n_samples: int | None = N_SAMPLES,
                  batch_size: int = BATCH_SIZE, keys: list[str] | None = None) -> DataFrame:
    """Global sample index ``i`` in (keys, k) order, cap (None: all), and batch ids.

    ``batch_id = ceil(i / B)``: batch 0 is sample 0 alone, batch b holds samples
    (b-1)B+1 .. bB.  ``complete`` is false for a trailing batch that the
    reference would never apply.
    """
    keys = keys or ["doc_id"]
    per_doc = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nw"))
    doc_off = global_index(per_doc, keys, weight_col="_nw")
    idx = (samples.join(doc_off.select(*keys, "_offset"), keys)
           .withColumn("i", F.col("_offset") + F.col("k").cast("bigint"))
           .drop("_offset"))
    total = doc_off.agg(F.sum("_nw")).scalar()
    if n_samples is not None:
        idx = idx.filter(F.col("i") < n_samples)
        total = F.least(total, F.lit(n_samples))
    idx = idx.withColumn("batch_id", F.ceil(F.col("i") / F.lit(batch_size)).cast("bigint"))
    # a batch is applied once its last index b*B is reached (batch 0: index 0)
    return idx.withColumn("complete", (F.col("batch_id") * batch_size) <= total - 1)


def files_in_key_order(spark: SparkSession, path: str, key: str = "doc_id") -> list[list[str]]:
    """The files of a parquet table in groups whose key ranges do not overlap, in key order.

    Reads the key column alone; the driver gets a row a file, as for the listing of the table.
    """
    at = F.col("_metadata.file_path")
    found = (spark.read.parquet(path).groupBy(at.alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
             .filter("lo IS NOT NULL").orderBy("lo", "hi").collect())
    groups, top = [], None
    for file, lo, hi in found:
        if top is not None and lo <= top:
            groups[-1].append(file)
            top = max(top, hi)
        else:
            groups.append([file])
            top = hi
    return groups


def files_for_samples(spark: SparkSession, path: str, n_samples: int, tokenize: Callable[[DataFrame], DataFrame],
                      sample_size: int = SAMPLE_SIZE, key: str = "doc_id") -> list[str]:
    """L05, first phase: the files, in key order, that hold the first ``n_samples`` windows.

    Windows are counted, not made, in 1, 2, 4... groups of files at a time until the cap is reached.
    """
    groups, chosen, total, step = files_in_key_order(spark, path, key), [], 0, 1
    while groups and total < n_samples:
        now, groups = [f for g in groups[:step] for f in g], groups[step:]
        n = F.size("tokens")
        # a window of one token makes no sample
        usable = F.when(n > 1, windows_per_doc(n, sample_size)).otherwise(0) if sample_size > 1 else F.lit(0)
        total += tokenize(read_corpus(spark, now, key_col=key)).agg(F.sum(usable.cast("bigint"))).first()[0] or 0
        chosen, step = chosen + now, 2 * step
    return chosen


def capped_samples(spark: SparkSession, path: str, n_samples: int, tokenize: Callable[[DataFrame], DataFrame],
                   batch_size: int = BATCH_SIZE, sample_size: int = SAMPLE_SIZE, seed: int = RNG_SEED,
                   key: str = "doc_id") -> DataFrame:
    """L05/L06 over a table whose files are (mostly) in key order: only files below the cap are windowed.

    ``tokenize`` turns ``(key, text)`` into ``(key, tokens)``.  The rows are those of ``limit_samples`` over
    the windows of the whole table; files whose key ranges overlap are read together.
    """
    files = files_for_samples(spark, path, n_samples, tokenize, sample_size, key)
    corpus = read_corpus(spark, files, key_col=key) if files else read_corpus(spark, path, key_col=key).limit(0)
    wins = sample_windows(tokenize(corpus), sample_size, seed, keys=[key])
    return limit_samples(wins, n_samples, batch_size, keys=[key])


def exclude_validation(encoded: DataFrame, validation: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The training documents, without those the validation set drew (a few rows)."""
    keys = keys or ["doc_id"]
    return encoded.join(validation.select(*keys).distinct(), keys, "left_anti")


def validation_set(encoded: DataFrame, batch_size: int = BATCH_SIZE,
                   sample_size: int = SAMPLE_SIZE, seed: int = RNG_SEED,
                   tokens_col: str = "tokens", keys: list[str] | None = None) -> DataFrame:
    """Seeded sample of ``max(B // 10, 1)`` documents, first ``sample_size`` tokens.

    Documents shorter than ``sample_size`` are not eligible (the reference would
    abort on them).  Output: ``keys, x, y``.
    """
    keys = keys or ["doc_id"]
    n_val = max(batch_size // 10, 1)
    # Ineligible rows get a NULL draw and sort last; they are dropped *after* the
    # top-n, where the filter cannot be pushed into the scan (a pushed-down
    # size(tokens) filter would recompute the token arrays there).
    text = dict(encoded.dtypes)[tokens_col] == "string"      # a text's tokens are its characters
    n = F.length(tokens_col) if text else F.size(tokens_col)
    draw = F.when(n >= sample_size, seeded_hash_key(seed, *keys))
    picked = (encoded.select(*keys, tokens_col, draw.alias("_draw"))
              .orderBy(F.col("_draw").asc_nulls_last(), *keys).limit(n_val)
              .filter(F.col("_draw").isNotNull()).drop("_draw"))
    head = char_codes(F.substring(tokens_col, 1, sample_size)) if text else F.slice(tokens_col, 1, sample_size)
    return picked.select(*keys,
                         F.slice(head, 1, sample_size - 1).alias("x"),
                         F.slice(head, 2, sample_size - 1).alias("y"))
