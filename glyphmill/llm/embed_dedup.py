"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of one label are scaled to length one and rotated by a fixed random rotation, which
spreads distance evenly over the coordinates.  cos >= t means squared distance <= 2 (1 - t);
split into blocks, a linked pair stays within its proportional share of that budget in at
least one block.  Each block is range-joined by a grid whose cells are as wide as the share's
radius: a vector meets its own cell and the neighbouring ones, by one matrix product of block
coordinates; pairs within the budget are verified exactly by cosine in double precision.  A pair
is counted in the first block whose budget it meets, so no pairs leave the task: only each
vector's count of links and a spanning forest of the links.  Equal vectors are joined once, with
their number.

The grids lie in the task, so what is shuffled is not a copy a cell but a copy a tile: a label of
more than ``TILE`` vectors is cut into tiles that meet pairwise, and tiles grow with the label (to
``TILE_BYTES``) before a vector is in more than ``COPIES`` pairs.  Vectors travel in the element
type of the table, and are stored once, a row a class of equal ones.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label or id, link with nothing (component: own id); vectors of unlike lengths
never link; repeated rows are copies of one another, and rows that share a ``vec_id`` are
linked by their own vectors only; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import drop_saved, in_bit_table, salt, save
from glyphmill.llm.components import components

COSINE = 0.93
BLOCK_DIMS = 8
#: Vectors of a tile; a label above COPIES tiles gets larger ones, of TILE_BYTES at most.
TILE = 32_768
COPIES = 4
TILE_BYTES = 16 << 20
#: Vectors that a cell of the grid should hold in the mean, and cells along a coordinate.
CELL, CELLS = 256, 6
#: Tasks in which tiles meet, two for each meeting up to this number.
MOST_TASKS = 2_000
#: Entries of a block's distance matrix, and pairs verified, at once.
MATRIX = 1 << 20
PAIRS = 1 << 17
#: Room for rounding in block budgets; the final test is the cosine itself.
ROUNDING = 1e-9
SEED = 31


@functools.cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    """Coordinate ranges of about BLOCK_DIMS each."""
    n = max(1, dims // BLOCK_DIMS)
    cuts = [round(i * dims / n) for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budgets(dims: int, cosine: float) -> np.ndarray:
    return np.array([2 * (1 - cosine) * (b - a) / dims + ROUNDING for a, b in blocks(dims)])


def scaled(raw: list[bytes], kind: type = np.float64) -> np.ndarray:
    """Rows of doubles, each divided by its largest magnitude."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid_batches(kind: type):
    """Rows of (vec_id, label, raw): the vector's bytes, null where it can link with nothing."""
    size = np.dtype(kind).itemsize

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 27) * batch.num_rows // max(1, size * len(batch.column("embedding").values)))  # a binary column ends at 2 GB
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                col = rows.column("embedding")
                offs = col.offsets.to_numpy().astype(np.int64)
                child = col.values.slice(offs[0], offs[-1] - offs[0])
                values = np.ascontiguousarray(child.cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False), kind)
                bad = ~np.isfinite(values)
                bad[child.is_null().to_numpy(zero_copy_only=False)] = True
                offs -= offs[0]
                of_row = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offs])
                good = col.is_valid().to_numpy(zero_copy_only=False) & (of_row(bad) == 0) & (of_row(values != 0) > 0)
                raw = pa.Array.from_buffers(pa.binary(), len(rows), [
                    pa.py_buffer(np.packbits(good, bitorder="little").tobytes()),
                    pa.py_buffer((offs * size).astype(np.int32)), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), raw], names=["vec_id", "label", "raw"])
    return fn


def _candidates(own: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float, depth: int) -> Iterator[tuple]:
    """Places (i, j) of ``left`` x ``right`` that may lie within ``budget`` by their block coordinates ``own``.

    A grid over the first ``depth`` coordinates: a pair within the budget is in cells that are equal or
    neighbours along each.  If ``left`` is ``right``, each pair comes once.
    """
    same = left is right
    cell = np.floor(own[:, :depth] / (math.sqrt(budget) * (1 + 1e-9))).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    radix = cell.max(axis=0) + 2
    code = cell[:, 0]
    for c in range(1, depth):
        code = code * radix[c] + cell[:, c]
    left = left[np.argsort(code[left], kind="stable")]
    right = left if same else right[np.argsort(code[right], kind="stable")]
    there = code[right]
    begin = np.flatnonzero(np.diff(code[left], prepend=-1))
    end, at = np.append(begin[1:], len(left)), code[left[begin]]
    half = (own * own).sum(1) / 2
    most = budget / 2 + 4e-6  # room for single precision
    # own_i own_j - |own_j|^2 / 2 >= |own_i|^2 / 2 - budget / 2, in one product
    a = np.column_stack([own[left], np.ones(len(left))]).astype(np.float32)
    b = np.column_stack([own[right], -half[right]]).astype(np.float32)
    floor = (half[left] - most).astype(np.float32)[:, None]
    for step in itertools.product((-1, 0, 1), repeat=depth - 1):
        shift = 0  # cells that are neighbours along the last coordinate are neighbours in order
        for c, d in enumerate(step):
            shift = (shift + d) * radix[c + 1]
        lo, hi = np.searchsorted(there, at + shift - 1), np.searchsorted(there, at + shift + 1, "right")
        if same:
            lo = np.maximum(lo, begin)
        for v, w, x, y in zip(begin.tolist(), end.tolist(), lo.tolist(), hi.tolist(), strict=True):
            n = MATRIX // max(1, y - x) + 1
            for r in range(v, w if y > x else v, n):
                hit = np.flatnonzero(a[r: min(r + n, w)] @ b[x: y].T >= floor[r: min(r + n, w)])
                i, j = hit // (y - x) + r, hit % (y - x) + x
                if same:
                    once = i < j
                    i, j = i[once], j[once]
                if len(i):
                    yield left[i], right[j]


def _gathered(pairs: Iterator[tuple]) -> Iterator[tuple]:
    """The same pairs, some PAIRS at a time."""
    held, n = [], 0
    for i, j in pairs:
        held.append((i, j))
        n += len(i)
        if n >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _join(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Add links to a forest in which every node points to its root; it stays so."""
    a, b = parent[p], parent[q]
    apart = np.unique(np.minimum(a, b)[a != b] * len(parent) + np.maximum(a, b)[a != b])
    for v, w in zip((apart // len(parent)).tolist(), (apart % len(parent)).tolist(), strict=True):
        v, w = _root(parent, v), _root(parent, w)
        if v != w:
            parent[max(v, w)] = min(v, w)
    while len(apart) and (parent != (up := parent[parent])).any():
        parent[:] = up


def _meet(cosine: float, kind: type = np.float64):
    """Within one (label, length, tile pair): counts of links and a spanning forest."""
    def fn(table: pa.Table) -> pa.Table:
        x = scaled(table.column("raw").to_pylist(), kind)
        xn = np.sqrt((x * x).sum(1))
        dims = x.shape[1]
        y = unit(x) @ rotation(dims)
        near, slack = unit(x).astype(np.float32), 1.2e-7 * dims + 1e-6
        cuts, most = blocks(dims), budgets(dims, cosine)
        starts = np.array([a for a, _ in cuts])
        ids = table.column("id").to_numpy()
        mult = table.column("mult").to_numpy()
        tile, t, u = (table.column(c).to_numpy() for c in ("tile", "t", "u"))
        left = np.flatnonzero(tile == t[0])
        right = left if t[0] == u[0] else np.flatnonzero(tile == u[0])
        links = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))
        depth = max(1, int(math.log(max(1, len(right) / CELL), CELLS)))
        for block, (lo, hi) in enumerate(cuts if len(left) and len(right) else []):
            found = _candidates(y[:, lo: hi], left, right, most[block], min(depth, hi - lo))
            for i, j in _gathered(found):
                for a in range(0, len(i), PAIRS):
                    p, q = i[a: a + PAIRS], j[a: a + PAIRS]
                    likely = np.einsum("ij,ij->i", near[p], near[q]) >= cosine - slack
                    p, q = p[likely], q[likely]
                    good = (x[p] * x[q]).sum(1) / (xn[p] * xn[q]) >= cosine
                    p, q = p[good], q[good]
                    gap = y[p] - y[q]
                    each = np.add.reduceat(gap * gap, starts, axis=1) <= most
                    first = each[:, block] & ~each[:, :block].any(axis=1)
                    p, q = p[first], q[first]
                    np.add.at(links, p, mult[q])
                    np.add.at(links, q, mult[p])
                    _join(parent, p, q)
        hit = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[hit], pa.int64()), "links": pa.array(links[hit]),
                         "root": pa.array(ids[parent[hit]], pa.int64())})
    return fn


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    label = vectors.schema["label"].dataType.simpleString()
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    key = ["label", "key"]
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(
        _valid_batches(kind), f"vec_id long, label {label}, raw binary").withColumn("key", F.unhex(F.md5("raw")))
    rows = save(whole.drop("raw"), "vector-keys")
    able = "key IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL"
    # a class of equal vectors has a number of its own: a repeated vec_id may stand in several
    several = save(rows.filter(able).groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1"), "vector-classes")
    marked = in_bit_table(whole.filter(able), several, "key", "_flag")  # most vectors are alone, and not shuffled for this
    shared = marked.filter("_flag").join(several, key, "left").filter("n IS NULL OR vec_id = least").dropDuplicates(key)
    reps = save(marked.filter("NOT _flag").select(*key, "vec_id", F.lit(1).cast("long").alias("mult"), "raw").unionByName(
        shared.select(*key, "vec_id", F.coalesce("n", F.lit(1)).alias("mult"), "raw")).select(
        F.monotonically_increasing_id().alias("id"), *key, "vec_id", "mult", F.length("raw").alias("size"), "raw"), "vector-representatives")
    sizes = save(reps.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "vector-sizes")
    held = F.least(F.greatest(F.lit(tile), F.ceil(F.col("n") / COPIES)), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / F.col("size"))))
    tiles = F.ceil(F.col("n") / held).cast("int")
    meets = sizes.agg(F.sum(tiles * (tiles + 1) / 2)).first()[0] or 0
    # by their number: time goes with the pairs, not with the bytes that would be put together to a task
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, 2 * int(meets)))
    dealt = (reps.select("id", "mult", "label", "size", "raw").join(sizes, ["label", "size"]).withColumn("tiles", tiles)
             .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("t", F.least("tile", "other")).withColumn("u", F.greatest("tile", "other"))
             .drop("n", "tiles", "other").repartition(tasks, "label", "size", "t", "u"))
    found = save(dealt.groupBy("label", "size", "t", "u").applyInArrow(_meet(cosine, kind), "id long, links long, root long"),
                 "vector-links")
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    numbered = reps.select(*key, "id", F.col("vec_id").alias("rep"), "mult").join(totals, "id", "left").join(
        comps, "id", "left").filter("links IS NOT NULL OR mult > 1")
    least = numbered.groupBy("component").agg(F.min("rep").alias("least")).filter("component IS NOT NULL")
    classes = save(numbered.join(least, "component", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("least", "rep").alias("component_id")), "vector-results")
    for old in (several, reps, sizes, found, comps):
        drop_saved(old)
    marked = in_bit_table(rows.filter(able), classes, "key", "_flag")
    salted = marked.filter("_flag").select("vec_id", *key).withColumn("_salt", salt("vec_id"))
    spread = salted.select(*key, "_salt").distinct().join(classes, key)  # at most SALTS rows a class
    linked = salted.join(spread, [*key, "_salt"], "left").select("vec_id", "n_links", "component_id")
    alone = marked.filter("NOT _flag").select("vec_id").unionByName(rows.filter(f"NOT ({able})").select("vec_id"))
    out = linked.unionByName(alone, allowMissingColumns=True).select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
