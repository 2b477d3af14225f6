"""Filter interaction audit over a sparse document-term matrix.

Five filters (failure conditions ``A`` to ``E``) are applied in every order, and each step's
effect is counted by part of the corpus::

    docs -> mapInArrow: texts in shards of bounded size; a shard's own words (as 64-bit hashes)
            and packed CSR arrays over them                                                  [saved]
         -> (hash, shard, place), one row a shard and word, dealt by ranges of the hash
         -> mapInArrow: number the distinct hashes; a row of (places, numbers) for each shard
         -> those rows meet their shard's arrays: CSR shards over global numbers
              row sum = words (A), non-zero count = distinct words (B)                       [saved]
         -> further flags: C, D from the text pass, E from the smallest doc_id of equal texts
         -> count by (part, mask of failures) -> 120 orders x 5 steps over at most 32 masks a part

A word travels once a shard, so the commonest word is one row a shard, and no row of the matrix
leaves its shard.  A shard numbers its words in the order of their hashes, and so does the
dictionary, so rows stay sorted when they are renumbered.  Words are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words, so it fails A alone (0 of 0 words is not below
half).  A row without ``doc_id`` never fails E and makes none fail; rows that share a ``doc_id``
do not make one another fail E.  A document is good or toxic when one of its label rows says so.
An empty table gives no parts and no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb
from glyphmill.llm.common import group_attributes, save
from glyphmill.llm.exchange import join_parts, pack, split_parts, unpack

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = "#$%&*|"

#: Bytes of text in a shard; one longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Rows of (hash, shard, place) that a task numbers at once, and hash ranges a partition.
PART_WORDS = 1 << 20
RANGES = 4

_IS_UPPER = np.zeros(256, np.uint8)
_IS_UPPER[65:91] = 1
_IS_SYMBOL = np.zeros(256, np.uint8)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_IS_START = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)

_SHARD = [("shard", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("f1", pa.int64()),
          ("f2", pa.int64()), ("fails_c", pa.bool_()), ("fails_d", pa.bool_()), ("csr", pa.binary()),
          ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.binary()))]
_SHARD_SCHEMA = ("shard long, at int, doc_id long, part string, f1 long, f2 long, fails_c boolean, fails_d boolean, "
                 "csr binary, hashes array<long>, words array<binary>")


def text_sums(body: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text, the sum of ``table`` over its bytes."""
    total = np.zeros(int(offs[-1] - offs[0]) + 1, np.int64)
    np.cumsum(table[body[offs[0]: offs[-1]]], out=total[1:])
    return total[offs[1:] - offs[0]] - total[offs[:-1] - offs[0]]


def shard_matrix(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """CSR arrays (indptr, indices, data) of the texts' words, the words' hashes in order, and the words."""
    lists = pc.ascii_split_whitespace(texts)
    offs, flat = lists.offsets.to_numpy(), lists.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(offs))
    full = pc.greater(pc.binary_length(flat), 0)
    row, flat = row[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    coded = flat.dictionary_encode()
    body, ends = tb.column(coded.dictionary)
    prefix = tb.running(tb.BYTE_WORD[body[ends[0]: ends[-1]]])
    hashes, first, place = np.unique(tb.span_hash(prefix, ends[:-1] - ends[0], ends[1:] - ends[0]),
                                     return_index=True, return_inverse=True)
    n_words = max(1, len(hashes))
    cells, data = np.unique(row * n_words + place[coded.indices.to_numpy()], return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(texts) + 1) * n_words)
    return indptr, cells % n_words, data, hashes, coded.dictionary.take(pa.array(first)).cast(pa.binary())


def _one_list(values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _rows(n: int, **columns) -> pa.RecordBatch:
    cols = [columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _SHARD]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in
                                       zip(cols, _SHARD, strict=True)], names=[name for name, _ in _SHARD])


def _shards(with_words: bool):
    """Per shard: a row for each document with its flags, then one row (at -1) with the matrix and its words."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            text = batch.column("text").fill_null("")
            body, offs = tb.column(text)
            for lo, hi in tb.slices(offs, SHARD_BYTES):
                n, mine, spans = hi - lo, batch.slice(lo, hi - lo), offs[lo: hi + 1]
                shouts = 100 * text_sums(body, spans, _IS_UPPER) > UPPER_PERCENT * text_sums(body, spans, _IS_START)
                yield _rows(n, shard=np.full(n, number), at=np.arange(n), fails_c=shouts,
                            fails_d=text_sums(body, spans, _IS_SYMBOL) > 0,
                            **{c: mine.column(c) for c in ("doc_id", "part", "f1", "f2")})
                indptr, indices, data, hashes, words = shard_matrix(text.slice(lo, n))
                steps = np.diff(indices, prepend=0)
                csr = join_parts([pack(np.diff(indptr)), pack((steps << 1) ^ (steps >> 63)), pack(data - 1)])
                more = {"words": _one_list(words)} if with_words else {}
                yield _rows(1, shard=[number], at=[-1], csr=[csr], hashes=_one_list(pa.array(hashes.view(np.int64))), **more)
                number += 1

    return fn


def shards(docs: DataFrame, with_words: bool = False) -> DataFrame:
    """The documents of (doc_id, text, part, f1, f2) in shards, saved."""
    return save(docs.select("doc_id", "text", "part", "f1", "f2").mapInArrow(_shards(with_words), _SHARD_SCHEMA), "audit-shards")


_NUMBERED = "shard long, places array<int>, numbers array<long>"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, hash, shard, place) sorted by (range, hash) -> per shard its places and their global numbers.

    The n-th distinct hash of a range gets the number (range << 32) + n.
    """
    parts = [tuple(b.column(c).to_numpy() for c in ("range", "hash", "shard", "place")) for b in batches if b.num_rows]
    if not parts:
        return
    where, h, shard, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (where[1:] != where[:-1])
    nth = np.cumsum(new) - 1
    first = np.flatnonzero(np.diff(where, prepend=where[0] - 1))
    nth -= np.repeat(nth[first], np.diff(np.append(first, len(h))))
    order = np.lexsort((place, shard))
    shard, place, number = shard[order], place[order], ((where << 32) + nth)[order]
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)), len(shard)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (place, number)]
    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), *lists], names=["shard", "places", "numbers"])


def word_numbers(heads: DataFrame) -> DataFrame:
    """(shard, places, numbers): the global numbers of each shard's own words, in rows of any size."""
    n_words = heads.agg(F.sum(F.size("hashes").cast("long"))).first()[0] or 0
    n = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // PART_WORDS))
    own = heads.select("shard", F.posexplode("hashes").alias("place", "hash"))
    spot = F.shiftright(F.shiftrightunsigned("hash", 32) * F.lit(n * RANGES), 32)
    dealt = own.withColumn("range", spot).repartition(n, "range").sortWithinPartitions("range", F.col("hash"))
    return dealt.select("range", "hash", "shard", "place").mapInArrow(_number, _NUMBERED)


_CSR = "shard long, n_rows int, indptr array<long>, indices array<long>, data array<long>"


def _global_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, indptr, indices, data) of each shard, from its arrays and numbers sorted by (shard, numbers last)."""
    at, csr, number = None, None, None

    def made():
        sizes, steps, more = (unpack(p).view(np.int64) for p in split_parts(csr))
        indices = np.cumsum((steps >> 1) ^ -(steps & 1))
        return at, np.concatenate([[0], np.cumsum(sizes)]), number[indices], more + 1

    for batch in batches:
        shard, size = batch.column("shard").to_pylist(), batch.column("n_own").to_pylist()
        for i in range(batch.num_rows):
            if shard[i] != at:
                if at is not None:
                    yield made()
                at, csr, number = shard[i], batch.column("csr")[i].as_py(), np.full(size[i], -1, np.int64)
            else:
                number[batch.column("places")[i].values.to_numpy()] = batch.column("numbers")[i].values.to_numpy()
    if at is not None:
        yield made()


def _met(shard_rows: DataFrame) -> DataFrame:
    heads = shard_rows.filter("at < 0")
    rows = heads.select("shard", F.size("hashes").alias("n_own"), "csr").unionByName(
        word_numbers(heads.select("shard", "hashes")), allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("csr").isNull())


def matrix(shard_rows: DataFrame) -> DataFrame:
    """CSR shards (shard, n_rows, indptr, indices, data) over the global dictionary."""
    def fn(batches):
        for number, indptr, indices, data in _global_shards(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(indptr) - 1], pa.int32()),
                 *[_one_list(pa.array(v)) for v in (indptr, indices, data)]], names=[f.split()[0] for f in _CSR.split(", ")])
    return _met(shard_rows).mapInArrow(fn, _CSR)


def row_figures(shard_rows: DataFrame) -> DataFrame:
    """(shard, at, n_words, n_distinct): row sums and non-zero counts of the matrix, shard by shard."""
    def fn(batches):
        for number, indptr, indices, data in _global_shards(batches):
            n = len(indptr) - 1
            row = np.repeat(np.arange(n), np.diff(indptr))
            # a row's indices are sorted; a number counts once
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (indices[1:] != indices[:-1])
            total = np.concatenate([[0], np.cumsum(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(total[indptr[1:]] - total[indptr[:-1]]), pa.array(np.bincount(row[new], minlength=n))],
                names=["shard", "at", "n_words", "n_distinct"])
    return _met(shard_rows).mapInArrow(fn, "shard long, at int, n_words long, n_distinct long")


def dictionary(shard_rows: DataFrame) -> DataFrame:
    """(word, number) of every distinct word; the shards must have been made ``with_words``."""
    heads = shard_rows.filter("at < 0")
    numbered = word_numbers(heads.select("shard", "hashes")).select("shard", F.explode(F.arrays_zip("places", "numbers")).alias("x"))
    words = heads.select("shard", F.posexplode("words").alias("place", "word"))
    return words.join(numbered.select("shard", F.col("x.places").alias("place"), F.col("x.numbers").alias("number")),
                      ["shard", "place"]).select("word", "number").distinct()


def document_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n_words, n_distinct): bit i of ``mask`` is set where the document fails filter i."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(12), text).alias("f2"))
    found = shards(rows)
    figures = save(row_figures(found), "audit-figures")
    flags = found.filter("at >= 0").select("shard", "at", "doc_id", "part", "f1", "f2", "fails_c", "fails_d")
    flags = flags.join(figures, ["shard", "at"])
    smallest = {"_least": F.min("doc_id")}
    flags = group_attributes(flags, ["f1", "f2"], "doc_id", smallest, {"_least": F.min("_least")})
    fails = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), F.col("fails_c"),
             F.col("fails_d"), F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))]
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails)), F.lit(0))
    return flags.select("doc_id", "part", mask.alias("mask"), "n_words", "n_distinct")


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """The flags with ``good`` and ``toxic``; rows without a doc_id or a label have neither."""
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    known = flags.filter("doc_id IS NOT NULL").join(one, "doc_id", "left")
    other = flags.filter("doc_id IS NULL").withColumn("good", F.lit(0).cast("long")).withColumn("toxic", F.lit(0).cast("long"))
    return known.unionByName(other).fillna(0, ["good", "toxic"])


def steps() -> list[dict]:
    """Every (order, step): the step's filter and the filters applied before it, as bits."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step, "own": 1 << i, "before": before})
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step) with the counts of that step."""
    masks = labelled(document_flags(docs), labels).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, own int, before int>>")
    # at most 32 masks a part, each with the 600 steps
    at = masks.select("*", F.explode(plan).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    bits = F.col("mask")
    fails, gone = bits.bitwiseAND(F.col("own")) != 0, bits.bitwiseAND(F.col("before")) != 0
    total = lambda what, cond: F.sum(F.when(cond, F.col(what)).otherwise(0)).cast("long")
    counted = at.groupBy("part", "filter_order", "step", "own").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"), total("n", bits == F.col("own")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return counted.withColumn("shapley", shapley).drop("own")
