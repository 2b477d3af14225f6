"""N-sequence statistics over a text corpus.

Plan shape (corpus scope)::

    scan(text) -> explode(segments) -> HashAggregate(segment) [partial + final]
               -> explode(windows) -> HashAggregate(window)   [partial + final]
               -> Filter(count > 1 AND legal)                  [above the aggregate]

Windows are generated once per *distinct* segment and weighted by its frequency,
so window work grows with the number of distinct pieces (Heaps' law), not with
the raw corpus.  A hot segment ("the", " ") is a single row after the partial
aggregate, so it cannot skew the second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import char_array, legal, nseq_windows, segments
from glyphmill.operators import packed
from glyphmill.session import ensure_worker_import

#: Code points whose windows a task counts at once; a longer text is counted alone.
SLICE_CHARS = 1 << 19


def segment_counts(corpus: DataFrame, scope: str = "corpus") -> DataFrame:
    """T08 + frequency: ``(segment, freq)`` or, with ``scope='doc'``, ``(doc_id, segment, freq)``.

    ``corpus`` has columns ``doc_id`` and ``text`` (null texts already handled).
    """
    keys = _scope_keys(scope)
    pieces = corpus.select(*keys, F.explode(segments(F.col("text"))).alias("segment"))
    return pieces.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("freq"))


def nseq_counts(corpus: DataFrame, n: int, scope: str = "corpus", min_count: int = 2,
                legal_only: bool = True) -> DataFrame:
    """Counts of character n-sequences, keeping counts >= ``min_count``.

    With ``legal_only`` only windows whose text is a legal token are kept (the
    reference's candidate rule); the regex runs once per distinct window because
    it tests an aggregate output, which Catalyst cannot push below the aggregate.
    Output: ``[doc_id,] nseq STRING, cnt BIGINT``.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    keys = _scope_keys(scope)
    if keys:
        # null keys are one group, as for groupBy
        repeated = corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
        if repeated.isEmpty():
            return row_counts(corpus, keys, n, min_count, legal_only)
        repeated = repeated.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        alone = row_counts(corpus.join(repeated, same, "left_anti"), keys, n, min_count, legal_only)
        return alone.unionByName(_grouped_counts(corpus.join(repeated, same, "left_semi"), keys, n, min_count, legal_only))
    return _grouped_counts(corpus, keys, n, min_count, legal_only)


def row_counts(corpus: DataFrame, keys: list[str], n: int, min_count: int = 2, legal_only: bool = True) -> DataFrame:
    """``nseq_counts`` of rows whose keys no other row has: counted in the map task, nothing is shuffled.

    A window that crosses a segment's border is not legal, so whole texts are counted.
    """
    ensure_worker_import(corpus.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, lo = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(), dtype=np.int64), 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
                rows, lo = batch.slice(lo, hi - lo), hi
                row, nseq, cnt = _counted_windows(pc.fill_null(rows.column("text"), ""), n, min_count)
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(row)) for k in keys), nseq, pa.array(cnt)],
                                                 names=[*keys, "nseq", "cnt"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in corpus.schema.fields if f.name == k)
    found = corpus.select(*keys, "text").mapInArrow(run, f"{fields}, nseq string, cnt bigint")
    return found.filter(legal(F.col("nseq"))) if legal_only else found


def _counted_windows(texts: pa.Array, n: int, min_count: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, window text, count) of the windows that a text holds ``min_count`` times or more."""
    codes, offs = packed.char_codes(texts)
    starts = packed.window_starts(offs, n)
    row = np.searchsorted(offs, starts, side="right") - 1
    ids = codes[starts]
    for j in range(1, n):
        if j > 1:
            ids = np.unique(ids, return_inverse=True)[1]
        ids = ids << 21 | codes[starts + j]
    ids = np.unique(ids, return_inverse=True)[1]
    key = row * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    cnt = np.diff(np.append(first, len(key)))
    at = order[first[cnt >= min_count]]
    windows = codes[starts[at][:, None] + np.arange(n)].reshape(-1)
    return row[at], packed.texts_of(windows, np.arange(len(at) + 1) * n), cnt[cnt >= min_count].astype(np.int64)


def _grouped_counts(corpus: DataFrame, keys: list[str], n: int, min_count: int, legal_only: bool) -> DataFrame:
    """``nseq_counts`` by grouping: for the whole corpus, and for keys on several rows."""
    if not legal_only:
        # windows may cross any border: the whole text, one aggregate
        texts, freq = corpus.select(*keys, F.col("text").alias("segment")), F.count(F.lit(1))
    elif keys:
        # a document's windows are all in its row: one aggregate is enough
        texts = corpus.select(*keys, F.explode(segments(F.col("text"))).alias("segment"))
        freq = F.count(F.lit(1))
    else:
        texts, freq = segment_counts(corpus), F.sum("freq")
    texts = texts.filter(F.length("segment") >= n)
    rest = [c for c in texts.columns if c != "segment"]
    wins = texts.select(*rest, F.explode(nseq_windows(char_array(F.col("segment")), n)).alias("w"))
    counted = (wins.select(*rest, F.array_join("w", "").alias("nseq"))
               .groupBy(*keys, "nseq").agg(freq.alias("cnt")))
    return counted.filter(keep_candidate(F.col("cnt"), F.col("nseq"), min_count, legal_only))


def keep_candidate(cnt, text, min_count: int = 2, legal_only: bool = True):
    """Count threshold and legality as ONE predicate that also reads the aggregate.

    A plain ``cnt >= k AND legal(text)`` would be split by Catalyst and the regex
    half pushed below the aggregate (back to once per occurrence); a CASE that
    reads the aggregate output cannot be pushed, so the regex runs once per
    distinct window that passed the count test.
    """
    if not legal_only:
        return cnt >= min_count
    return F.when(cnt >= min_count, legal(text)).otherwise(F.lit(False))


def rank_order(count_col: str = "cnt", text_col: str = "nseq"):
    """T06 for character windows: count desc, then the window desc.

    For character-only windows, descending code-point order of the window equals
    descending string order (Spark and DuckDB compare strings by code point).
    """
    return [F.col(count_col).desc(), F.col(text_col).desc()]


def top_nseqs(corpus: DataFrame, n: int, k: int, scope: str = "corpus") -> DataFrame:
    """The ``k`` most common legal n-sequences (TakeOrderedAndProject)."""
    counted = nseq_counts(corpus, n, scope=scope)
    return counted.orderBy(*rank_order()).limit(k)


def _scope_keys(scope) -> list[str]:
    """'corpus' -> whole table; 'doc' -> per doc_id; a list -> per those key columns."""
    if isinstance(scope, (list, tuple)):
        return list(scope)
    if scope == "corpus":
        return []
    if scope == "doc":
        return ["doc_id"]
    raise ValueError("scope must be 'corpus', 'doc' or a list of key columns")
