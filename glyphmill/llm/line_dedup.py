"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

A document's lines are its text cut at ``\\n``.  A line's key is the line without ASCII white
space at both ends and with A-Z lower-cased.  Keys of at least ``MIN_CHARS`` code points found
in at least ``MIN_DOCS`` documents lose their lines except in the largest ``doc_id``
that holds them::

    docs -> (key hash, doc_id, text hash, position)      one row a long line     [saved]
         -> repartitionByRange + sort by (hash, doc_id descending, text hash, position)
         -> mapInArrow: stream the runs of equal hashes                          [saved]
              runs inside a partition are decided there: the first document keeps its lines
              runs at a partition's edge leave a figure for each side and their rows
         -> edge figures of one hash meet (at most two rows a partition) and decide those rows
         -> dropped positions by document -> compressed bitmaps of the lines to keep

Range bounds cut within a hash, so a line that a third of all documents hold is spread over
many partitions.  Only positions and bitmaps move; of the texts only those with a
dropped line meet their bitmap again.

Defined cases: a null or empty text is one empty line.  Rows that share a ``doc_id`` count as
one document, null ids together as one document below all others; a row is known by
(doc_id, hash of its text), and equal rows get the same bitmap.  Hashes of keys have 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import id_text, in_bit_table, null_safe_join, save

MIN_CHARS = 40
MIN_DOCS = 5

#: Rows of a run of equal hashes that a task holds back; a longer run is decided like one at an edge.
HELD_ROWS = 1 << 16
#: Rows a partition is meant to get.
PART_ROWS = 1 << 19

_SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DROP, PENDING, EDGE = 0, 1, 2
_RUN = [("kind", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()),
        ("fp", pa.int64()), ("pos", pa.int32()), ("docs", pa.int64()), ("last_doc", pa.int64())]
_RUN_SCHEMA = "kind int, part int, h1 long, h2 long, doc_id long, fp long, pos int, docs long, last_doc long"
_ROW = ["h1", "h2", "doc_id", "fp", "pos"]


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACES))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, fp, pos) of each line whose key is long enough."""
    rows = id_text(docs).select("doc_id", F.xxhash64(_text()).alias("fp"),
                                F.posexplode(F.split(_text(), "\n", -1)).alias("pos", "line"))
    keys = rows.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), "doc_id", "fp", "pos")


class _Rows:
    """Columns of some rows in order; ``doc`` has a flag beside it where the id is null."""

    def __init__(self, h1, h2, doc, none, fp, pos):
        self.cols = (h1, h2, doc, none, fp, pos)
        self.h1, self.h2, self.doc, self.none, self.fp, self.pos = self.cols

    def __len__(self):
        return len(self.h1)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        doc = batch.column("doc_id")
        num = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        return cls(num("h1"), num("h2"), doc.fill_null(0).to_numpy(zero_copy_only=False),
                   doc.is_null().to_numpy(zero_copy_only=False), num("fp"), num("pos"))

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else cls(*(np.concatenate(c) for c in zip(*(p.cols for p in parts), strict=True)))

    def cut(self, at) -> _Rows:
        return _Rows(*(c[at] for c in self.cols))

    def starts(self) -> np.ndarray:
        new = np.ones(len(self), bool)
        new[1:] = (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1])
        return new

    def new_docs(self, starts: np.ndarray) -> np.ndarray:
        new = starts.copy()
        new[1:] |= (self.doc[1:] != self.doc[:-1]) | (self.none[1:] != self.none[:-1])
        return new

    def key(self, i: int) -> tuple:
        return int(self.h1[i]), int(self.h2[i])

    def who(self, i: int):
        return None if self.none[i] else int(self.doc[i])

    def batch(self, kind: int, part: int) -> pa.RecordBatch:
        """The rows, each of several equal ones once."""
        new = self.new_docs(self.starts())
        new[1:] |= (self.fp[1:] != self.fp[:-1]) | (self.pos[1:] != self.pos[:-1])
        x = self.cut(new)
        n = len(x)
        cols = [np.full(n, kind, np.int32), np.full(n, part, np.int32), x.h1, x.h2, pa.array(x.doc, mask=x.none), x.fp, x.pos]
        cols = [c if isinstance(c, pa.Array) else pa.array(c) for c in cols] + [pa.nulls(n, t) for _, t in _RUN[len(cols):]]
        return pa.RecordBatch.from_arrays(cols, names=[name for name, _ in _RUN])


class _Edge:
    """A run whose rows wait for the figures of other partitions."""

    def __init__(self, rows: _Rows):
        self.key, self.first, self.docs, self.last = rows.key(0), rows.who(0), 0, None

    def add(self, rows: _Rows) -> None:
        one_run = np.zeros(len(rows), bool)
        one_run[0] = not self.docs or self.last != rows.who(0)
        self.docs += int(rows.new_docs(one_run).sum())
        self.last = rows.who(-1)

    def batch(self, part: int) -> pa.RecordBatch:
        values = [EDGE, part, *self.key, self.first, None, None, self.docs, self.last]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _RUN, strict=True)],
                                          names=[name for name, _ in _RUN])


def _decided(rows: _Rows, min_docs: int) -> np.ndarray:
    """Which rows of whole runs are dropped: not of the run's first document, in runs of enough documents."""
    starts = rows.starts()
    run = np.cumsum(starts) - 1
    nth = np.cumsum(rows.new_docs(starts))
    first = nth[np.flatnonzero(starts)]
    docs = np.bincount(run, weights=rows.new_docs(starts)).astype(np.int64)
    return (docs[run] >= min_docs) & (nth > first[run])


def stream_runs(min_docs: int, held_rows: int = HELD_ROWS):
    """mapInArrow body over rows in (hash, doc_id descending, text hash, position) order."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        edge: _Edge | None = None
        held: list[_Rows] = []          # the last run so far, unless it is an edge run
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch)
            if not begun:               # the partition's first run may have begun in another one
                edge, begun = _Edge(rows), True
            if edge is not None:
                more = (rows.h1 == edge.key[0]) & (rows.h2 == edge.key[1])
                n = len(rows) if more.all() else int(np.argmin(more))
                if n:
                    edge.add(rows.cut(slice(0, n)))
                    yield rows.cut(slice(0, n)).batch(PENDING, part)
                if n == len(rows):
                    continue
                yield edge.batch(part)
                edge, rows = None, rows.cut(slice(n, None))
            rows = _Rows.joined([*held, rows])
            last = int(np.flatnonzero(rows.starts())[-1])
            whole, held = rows.cut(slice(0, last)), [rows.cut(slice(last, None))]
            if last:
                yield whole.cut(_decided(whole, min_docs)).batch(DROP, part)
            if len(held[0]) > held_rows:
                edge = _Edge(held[0])
                edge.add(held[0])
                yield held[0].batch(PENDING, part)
                held = []
        if held:                        # the last run may go on in another partition
            edge = _Edge(held[0])
            edge.add(held[0])
            yield held[0].batch(PENDING, part)
        if edge is not None:
            yield edge.batch(part)

    return fn


def _dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, fp, pos) of every line to drop."""
    occ = save(occurrences(docs, min_chars), "lines")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-occ.count() // PART_ROWS))
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "fp", "pos"]
    dealt = occ.repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = save(dealt.select(*_ROW).mapInArrow(stream_runs(min_docs), _RUN_SCHEMA), "line-runs")
    # a few rows a partition: a run's partitions in order, less the documents that two of them share
    of_run = Window.partitionBy("h1", "h2")
    edges = (runs.filter(F.col("kind") == EDGE)
             .withColumn("shared", (F.row_number().over(of_run.orderBy("part")) > 1)
                         & F.lag("last_doc").over(of_run.orderBy("part")).eqNullSafe(F.col("doc_id")))
             .withColumn("total", F.sum(F.col("docs") - F.col("shared").cast("long")).over(of_run))
             .withColumn("keeper", F.first("doc_id").over(of_run.orderBy("part")))
             .filter(F.col("total") >= min_docs).select("h1", "h2", "part", "keeper"))
    pending = runs.filter(F.col("kind") == PENDING).join(edges, ["h1", "h2", "part"])
    return runs.filter(F.col("kind") == DROP).select("doc_id", "fp", "pos").unionByName(
        pending.filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "fp", "pos"))


def pack_keep(positions: np.ndarray) -> bytes:
    """A compressed bitmap, 1 a line to keep; lines behind its end are kept."""
    keep = np.ones((int(positions.max()) // 8 + 1) * 8, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_keep(keep: bytes | None, n_lines: int) -> np.ndarray:
    out = np.ones(n_lines, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines]
        out[:len(bits)] = bits
    return out


_MAP_SCHEMA = "doc_id long, fp long, n_dropped long, keep binary"


def _pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions sorted by (doc_id, fp) -> a bitmap a document; holds one document's positions."""
    at, held = None, []

    def made(rows):
        ids, fps, maps = zip(*rows, strict=True)
        counts = [int((~unpack_keep(m, 8 * len(zlib.decompress(m)))).sum()) for m in maps]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(counts, pa.int64()),
             pa.array(maps, pa.binary())], names=["doc_id", "fp", "n_dropped", "keep"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc_id")
        none = doc.is_null().to_numpy(zero_copy_only=False)
        doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
        fp, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "pos"))
        new = (doc[1:] != doc[:-1]) | (none[1:] != none[:-1]) | (fp[1:] != fp[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(doc)]])
        done = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            who = (None if none[lo] else int(doc[lo]), int(fp[lo]))
            if who != at and held:
                done.append((*at, pack_keep(np.concatenate(held))))
                held = []
            at = who
            held.append(pos[lo:hi])
        if done:
            yield made(done)
    if held:
        yield made([(*at, pack_keep(np.concatenate(held)))])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, fp, n_dropped, keep) of each document with a dropped line.

    ``fp`` is ``xxhash64`` of the text (null: empty) and tells rows of one id apart; ``keep``
    is what ``unpack_keep`` reads.  Documents that lose nothing have no row.
    """
    drops = _dropped(docs, min_chars, min_docs)
    dealt = drops.repartition("doc_id", "fp").sortWithinPartitions("doc_id", "fp", "pos")
    return dealt.mapInArrow(_pack_documents, _MAP_SCHEMA)


def _cut_texts(with_text: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, counts, texts = [], [], []
            for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True):
                lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                kept = np.flatnonzero(unpack_keep(keep.as_py(), len(lines))).tolist()
                counts.append(len(lines))
                body = b"\n".join([lines[i] for i in kept])
                shas.append(hashlib.sha256(body).hexdigest())
                texts.append(body.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_dropped"),
                 pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    return fn


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = False) -> DataFrame:
    """One row a document: (doc_id, n_lines, n_dropped, kept_sha256[, kept_text]).

    Only texts whose (doc_id, text hash) a bitmap may have are shuffled to it; the others are read in place.
    """
    rows = id_text(docs).withColumn("fp", F.xxhash64(_text()))
    bitmaps = save(bitmaps, "line-bitmaps")
    marked = in_bit_table(rows, bitmaps, "fp", "_flag")
    n_lines = F.octet_length(_text()) - F.octet_length(F.replace(_text(), F.lit("\n"), F.lit(""))) + 1
    clear = marked.filter(~F.col("_flag")).select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
        F.sha2(_text(), 256).alias("kept_sha256"), (_text() if with_text else F.lit(None).cast("string")).alias("kept_text"))
    met = null_safe_join(marked.filter("_flag").select("doc_id", "text", "fp"), bitmaps, ["doc_id", "fp"], "left")
    cut = met.select("doc_id", "text", "keep", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped")).mapInArrow(
        _cut_texts(with_text), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    both = clear.unionByName(cut)
    return both if with_text else both.drop("kept_text")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = False) -> DataFrame:
    """The operator: bitmaps of all documents, applied to them."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), with_text)
