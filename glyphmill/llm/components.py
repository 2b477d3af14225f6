"""Connected components of a link table by alternating star contractions.

Each task first contracts the links it holds to stars by union-find; the links stay
distributed.  A round then rewires every node towards the smallest neighbour it has seen.
Smallest neighbours are combined in the map tasks and written out, so that a hot node's
links meet them in a join that can be split.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import drop_saved, save


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links as (node, smallest node of its part), without loops."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(ids)))  # ids are sorted: the smaller place is the smaller id
    for x, y in zip(at[: len(a)].tolist(), at[len(a):].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    top = np.arange(len(ids))
    for i, r in enumerate(root):  # a root stands before its nodes
        top[i] = i if r == i else top[r]
    moved = top != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[top[moved]])], names=["a", "b"])


def contracted(links: DataFrame) -> DataFrame:
    return links.mapInArrow(_contract, "a long, b long")


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest v of its u; a hot u's pairs can be split."""
    least = save(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Connect each larger neighbour of a node with the smallest of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect each smaller neighbour of a node, and the node, with the smallest of them."""
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    moved = _least(pairs).select(F.explode(F.array(
        F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
    return moved.select("x.a", "x.b").filter("a > b")


def _figures(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id each linked node reaches, for every node of (a, b)."""
    now = save(contracted(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .filter("a > b")).distinct(), "links")
    before = _figures(now)
    while before[0]:
        large = save(_large_star(now), "large")
        new = save(_small_star(large).distinct(), "links")
        drop_saved(large)
        drop_saved(now)
        now, after = new, _figures(new)
        if after == before:
            break
        before = after
    return save(now.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("component")),
        F.struct(F.col("b").alias("id"), F.col("b").alias("component")))).alias("x"))
        .select("x.id", "x.component").distinct(), "components")
