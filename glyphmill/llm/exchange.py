"""Packed key lookups: many sorted 64-bit keys travel as one compressed binary row.

A task turns its texts into chunks of bounded size.  For each chunk it sends its distinct
keys (with values) to hash buckets; a bucket combines the values of equal keys over all
chunks and answers every chunk in the order it asked.  A key that half of the rows hold is
one entry a chunk, so no bucket or task gets a hot key's rows.  Chunks are numbered by
(scan partition, sequence); the same scan gives the same chunks again, and each chunk
carries a digest of its ids that is compared when the answers meet the chunk's texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb

#: Bytes of text in a chunk, and of text a bucket answers for.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20

ROW = "chunk long, kind int, bucket int, data binary"
STATE, ANSWER = 0, 1


def pack(values: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes (small values and small steps take few bytes)."""
    planes = np.ascontiguousarray(values.astype(np.uint64, copy=False)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def join_parts(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return head + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [data[e - s: e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


class Chunk:
    """Some texts: ids, one buffer of bytes and offsets into it."""

    def __init__(self, number: int, doc_id: np.ndarray, body: np.ndarray, offs: np.ndarray):
        self.number, self.doc_id, self.body, self.offs = number, doc_id, body, offs

    def digest(self) -> int:
        return int(np.bitwise_xor.reduce(tb.mix(self.doc_id.view(np.uint64) + np.uint64(1)), initial=0)
                   ^ np.uint64(self.offs[-1])) & (2**63 - 1)

    def packed(self) -> bytes:
        return join_parts([pack(self.doc_id.view(np.uint64)), pack(np.diff(self.offs)),
                      zstandard.ZstdCompressor(level=1).compress(self.body.tobytes())])

    @classmethod
    def unpacked(cls, number: int, data: bytes) -> Chunk:
        doc_id, sizes, body = split_parts(data)
        offs = np.concatenate([[0], np.cumsum(unpack(sizes).astype(np.int64))])
        return cls(number, unpack(doc_id).view(np.int64),
                   np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), offs)


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The partition's texts as chunks, cut by the running size of the texts alone."""
    base = TaskContext.get().partitionId() << 24
    doc_ids: list[int] = []
    bodies: list[np.ndarray] = []
    sizes: list[int] = []
    held = number = 0

    def made() -> Chunk:
        offs = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
        return Chunk(base + number, np.array(doc_ids, np.int64), np.concatenate(bodies), offs)

    for batch in batches:
        body, offs = tb.column(batch.column("text"))
        doc_id = tb.ids(batch.column("doc_id"))
        lo = 0
        while lo < len(doc_id):
            room = max(0, most - held)
            hi = int(np.searchsorted(offs, offs[lo] + room, side="right")) - 1
            if hi <= lo:
                if doc_ids:
                    yield made()
                    number += 1
                    doc_ids, bodies, sizes, held = [], [], [], 0
                    continue
                hi = lo + 1
            hi = min(hi, len(doc_id))
            doc_ids += doc_id[lo:hi].tolist()
            bodies.append(body[offs[lo]: offs[hi]].copy())
            sizes += np.diff(offs[lo: hi + 1]).tolist()
            held += int(offs[hi] - offs[lo])
            lo = hi
    if doc_ids:
        yield made()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    chunk, kind, bucket, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()),
         pa.array(data, pa.binary())], names=["chunk", "kind", "bucket", "data"])


def batched(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def state(docs: DataFrame, packed: Callable[[Chunk], bytes] = Chunk.packed) -> DataFrame:
    """One packed row a chunk: what the answers are brought back to."""
    def fn(batches):
        return batched((c.number, STATE, 0, join_parts([np.int64(c.digest()).tobytes(), packed(c)]))
                       for c in chunks(batches))
    return docs.select("doc_id", "text").mapInArrow(fn, ROW)


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in a sorted key array (buckets cut the 64-bit range evenly)."""
    step = (1 << 64) // buckets + 1
    bounds = np.array([min(b * step, 2**64 - 1) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def ask(chunk: Chunk, kind: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Request rows of a chunk: ``keys`` sorted and distinct, value arrays beside them."""
    at = edges(keys, buckets)
    mark = np.int64(chunk.digest()).tobytes()
    for b in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[b], at[b + 1])
        steps = np.diff(keys[part], prepend=np.uint64(0))
        yield chunk.number, kind, b, join_parts([mark, pack(steps), *[pack(v[part]) for v in values]])


def answer(requests: DataFrame, partitions: int,
           combine: Callable[[int, np.ndarray, list[np.ndarray]], list[np.ndarray]],
           extra: Callable[[int, np.ndarray, list[np.ndarray]], bytes] | None = None) -> DataFrame:
    """Combine equal keys within each (kind, bucket) and answer every chunk in its own order.

    ``combine(kind, first, sorted values)`` reduces values at group starts ``first``; ``extra``
    may add one row of figures a bucket (kind -1 - kind, chunk -1).
    """
    def solve(kind, bucket, rows):
        parts = [split_parts(r[1]) for r in rows]
        keys = [np.cumsum(unpack(p[1]), dtype=np.uint64) for p in parts]
        sizes = [len(k) for k in keys]
        values = [np.concatenate([unpack(p[2 + i]).view(np.int64) for p in parts])
                  for i in range(len(parts[0]) - 2)]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every = every[order]
        new = np.empty(len(every), bool)
        new[0] = True
        np.not_equal(every[1:], every[:-1], out=new[1:])
        first = np.flatnonzero(new)
        totals = combine(kind, first, [v[order] for v in values])
        if extra is not None:
            yield -1, -1 - kind, bucket, extra(kind, every[first], totals)
        where = np.empty(len(every), np.int64)
        where[order] = np.cumsum(new) - 1
        lo = 0
        for (chunk, _), part, size in zip(rows, parts, sizes, strict=True):
            mine = where[lo: lo + size]
            lo += size
            yield chunk, kind, bucket, join_parts([part[0], *[pack(t[mine]) for t in totals]])

    return solve_buckets(requests, partitions, solve)


def solve_buckets(requests: DataFrame, partitions: int,
                  solve: Callable[[int, int, list[tuple]], Iterator[tuple]]) -> DataFrame:
    """Deal requests to buckets and hand each bucket's (chunk, data) rows to ``solve``, one at a time."""
    def fn(batches):
        def rows():
            held, at = [], None
            for batch in batches:
                cols = [batch.column(n).to_pylist() for n in ("chunk", "kind", "bucket", "data")]
                for chunk, kind, bucket, data in zip(*cols, strict=True):
                    if (kind, bucket) != at and held:
                        yield from solve(*at, held)
                        held = []
                    at = (kind, bucket)
                    held.append((chunk, data))
            if held:
                yield from solve(*at, held)
        return batched(rows())

    dealt = requests.repartition(partitions, "kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk")
    return dealt.mapInArrow(fn, ROW)


class Meeting:
    """A chunk (or what ``opened`` made of its state) with the answers to its requests, by kind, in key order."""

    def __init__(self, chunk, answers: dict[int, list[np.ndarray]]):
        self.chunk, self.answers = chunk, answers


def _meetings(batches: Iterator[pa.RecordBatch], opened: Callable) -> Iterator[Meeting]:
    def built(number, rows):
        mark, body = split_parts(rows[0][2])
        got: dict[int, list] = {}
        for kind, _, data in rows[1:]:
            other, *values = split_parts(data)
            if other != mark:
                raise RuntimeError("a chunk changed between two reads of the input")
            got.setdefault(kind, []).append([unpack(v) for v in values])
        return Meeting(opened(number, body),
                       {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in got.items()})

    held, at = [], None
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("chunk", "kind", "bucket", "data")]
        for chunk, kind, bucket, data in zip(*cols, strict=True):
            if chunk != at and held:
                yield built(at, held)
                held = []
            at = chunk
            held.append((kind, bucket, data))
    if held:
        yield built(at, held)


def meet(states: DataFrame, answers: DataFrame, partitions: int,
         fn: Callable[[Iterator[Meeting]], Iterator[pa.RecordBatch]], schema: str,
         opened: Callable = Chunk.unpacked) -> DataFrame:
    """Bring the answers back to their chunks and run ``fn`` over (chunk, answers).

    ``opened(number, packed state)`` undoes the packing that ``state`` was given.
    """
    rows = states.unionByName(answers.filter(F.col("chunk") >= 0))
    dealt = rows.repartition(partitions, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return dealt.mapInArrow(lambda batches: fn(_meetings(batches, opened)), schema)


def buckets_for(n_bytes: int) -> int:
    return max(1, -(-n_bytes // BUCKET_BYTES))


def partitions_for(df: DataFrame, n_bytes: int, each: int = 4 * CHUNK_BYTES) -> int:
    """Enough partitions that each holds a bounded share, and at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))
