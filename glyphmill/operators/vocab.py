"""Vocabulary training and resolution.

Training runs in rounds over a table of *distinct* segments weighted by their
frequency (exact, see ``functions.text.SEGMENT_BODY``)::

    round r:  segs(codes, parts, freq)                       [saved]
              -> windows that hold a token of round r - 1 (round 0: all) -> explode
              -> HashAggregate(window codes, text)
              -> Filter CASE(cnt > 1, legal(text))           [regex once per window]
              -> anti-join existing token texts (broadcast, <= vocab_size rows)
              -> HashAggregate(text): best window per text   [same-round duplicates]
              -> TakeOrderedAndProject(cnt desc, key desc, vocab_size - |vocab|)
              -> new ids on the <= cap rows; one pass of the new tokens over segs (mapInArrow,
                 map-only) keeps the segments that it changes

**Why a round counts only windows with a token of the round before.**  Let a window be old in a
round if all its components existed before the last round's tokens.  Old components that become
neighbours would need something between them to vanish, but a replacement leaves its token there;
so an old window's count never grows, its text stays as legal and as known as it was, and what
rejected it in an earlier round (count below 2, illegal, known text, a better window of the same text)
still does.  (The cap also rejects, but then training ends.)  So only windows with a new token can
become tokens.  All their occurrences are in segments that the last pass changed, which gives exact counts
from those segments alone; a segment that a pass does not change never changes again and leaves the
table.  For the same reason one pass with the new tokens reaches the fixed point of the whole vocabulary.

Everything that grows with the corpus stays distributed; only the new tokens of
a round (bounded by ``vocab_size``) reach the driver, to be broadcast as one packed array.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.text import (
    TOK_ID_OFFSET, char_array, char_codes, code_to_text, legal, nseq_sort_key, nseq_windows)
from glyphmill.operators import packed
from glyphmill.operators.nseq import keep_candidate, segment_counts
from glyphmill.session import drop_scratch, ensure_worker_import, save_scratch

VOCAB_SCHEMA = T.StructType([
    T.StructField("code", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("comps", T.ArrayType(T.LongType(), False), False),
    T.StructField("unrolled", T.StringType(), False),
])

REPORT_SCHEMA = T.StructType([
    T.StructField("round", T.IntegerType(), False),
    T.StructField("new_tokens", T.LongType(), False),
    T.StructField("vocab_count", T.LongType(), False),
    T.StructField("full", T.BooleanType(), False),
    T.StructField("segments_left", T.LongType(), False),
    T.StructField("windows", T.LongType(), False),
    T.StructField("input_bytes", T.LongType(), False),
    T.StructField("tokens_per_byte", T.DoubleType(), False),
    T.StructField("seconds", T.DoubleType(), False),
])


@dataclass
class Vocab:
    """A bounded vocabulary: ``n``, capacity and its entries (code -> comps, text)."""

    n: int
    vocab_size: int
    comps: dict[int, tuple[int, ...]] = field(default_factory=dict)
    texts: dict[int, str] = field(default_factory=dict)
    all_legal: bool = True
    _bc: object = None
    _bc_version: int = -1
    _packed: object = None
    _packed_version: int = -1
    _next: int = 0

    @property
    def count(self) -> int:
        return len(self.comps)

    @property
    def full(self) -> bool:  # T14
        return self.count >= self.vocab_size

    @property
    def next_free_id(self) -> int:
        return self._next

    def put(self, code: int, comps: tuple[int, ...], text: str) -> None:
        """Add an entry under its own code; the next free id stays above every id."""
        self.comps[code] = tuple(comps)
        self.texts[code] = text
        self._next = max(self._next, code - TOK_ID_OFFSET + 1)

    def add(self, comps: tuple[int, ...], text: str) -> int:
        code = TOK_ID_OFFSET + self._next
        self.put(code, comps, text)
        return code

    def table(self) -> dict[tuple[int, ...], int]:
        return {c: code for code, c in self.comps.items()}

    def broadcast(self, spark: SparkSession):
        """Broadcast {code -> text}; re-sent only when entries changed."""
        if self._bc is None or self._bc_version != self.count:
            if self._bc is not None:
                self._bc.unpersist()
            self._bc = spark.sparkContext.broadcast({"texts": dict(self.texts)})
            self._bc_version = self.count
        return self._bc

    def pack(self, since: int = 0) -> packed.Packed:
        """The entries with codes from ``since`` on as one open-addressing array."""
        codes = [c for c in self.comps if c >= since]
        return packed.Packed(np.array([self.comps[c] for c in codes], np.int64).reshape(-1, self.n),
                             np.array(codes, np.int64), self.n)

    def packed(self, spark: SparkSession):
        """Broadcast packed array of all entries; re-sent only when entries changed."""
        if self._packed is None or self._packed_version != self.count:
            if self._packed is not None:
                self._packed.unpersist()
            self._packed = spark.sparkContext.broadcast(self.pack())
            self._packed_version = self.count
        return self._packed

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(code, code - TOK_ID_OFFSET, list(c), self.texts[code])
                for code, c in sorted(self.comps.items())]
        return spark.createDataFrame(rows, VOCAB_SCHEMA)

    def display(self, code: int) -> str:
        """``id=(a|b)`` with nested tokens shown in full."""
        if code < TOK_ID_OFFSET:
            return chr(code)
        inner = "|".join(self.display(c) for c in self.comps[code])
        return f"{code - TOK_ID_OFFSET}=({inner})"


def _initial_segments(corpus: DataFrame, n: int) -> DataFrame:
    segs = segment_counts(corpus).filter(F.length("segment") >= n)
    return segs.select(char_codes(F.col("segment")).alias("codes"),
                       char_array(F.col("segment")).alias("parts"), "freq")


def _counted(windows: Column, newest: int | None, codes=lambda w: w) -> Column:
    """Of the windows of a segment, those that a round counts."""
    return windows if newest is None else F.filter(windows, lambda w: F.array_max(codes(w)) >= newest)


def round_candidates(segs: DataFrame, vocab_texts: DataFrame, n: int, cap_left: int | None,
                     newest: int | None = None) -> DataFrame:
    """T04-T06 and T09-T11 for one round: the <= ``cap_left`` tokens to add (None: all), in id order.

    With ``newest`` only windows with a component code from ``newest`` on are counted.
    """
    both = F.arrays_zip(nseq_windows(F.col("codes"), n).alias("c"), nseq_windows(F.col("parts"), n).alias("p"))
    wins = segs.select(F.explode(_counted(both, newest, lambda w: w["c"])).alias("w"), "freq")
    counted = (wins.select(F.col("w.c").alias("comps"),
                           F.array_join(F.col("w.p"), "").alias("unrolled"), "freq")
               .groupBy("comps", "unrolled").agg(F.sum("freq").alias("cnt")))
    cands = counted.filter(keep_candidate(F.col("cnt"), F.col("unrolled")))
    # An entry with the same components has the same text, so one
    # anti-join on text drops both kinds of already-known candidates.
    cands = cands.join(vocab_texts, "unrolled", "left_anti")
    cands = cands.withColumn("skey", nseq_sort_key(F.col("comps")))
    # Same-round duplicates by text -> keep the first in T06 order.
    best = (cands.groupBy("unrolled")
            .agg(F.max(F.struct("cnt", "skey", "comps")).alias("b"))
            .select("unrolled", "b.cnt", "b.skey", "b.comps"))
    # The cap; TakeOrderedAndProject keeps <= cap_left rows per partition.
    ranked = best.orderBy(F.col("cnt").desc(), F.col("skey").desc())
    return ranked if cap_left is None else ranked.limit(cap_left)


def train_vocab(corpus: DataFrame, n: int = 2, vocab_size: int = 1000,
                max_rounds: int | None = None, vocab: Vocab | None = None
                ) -> tuple[Vocab, DataFrame]:
    """Train (or continue training) a vocabulary over a ``(doc_id, text)`` corpus.

    Counting scope is the whole table: a window becomes a token when it occurs at
    least twice in the corpus.  For a one-row table this is exactly the
    reference's per-document ingest.  Returns the vocabulary and a per-round
    report DataFrame (T18).
    """
    if n < 2:
        raise ValueError("n must be >= 2")
    spark = corpus.sparkSession
    vocab = vocab or Vocab(n=n, vocab_size=vocab_size)
    input_bytes = corpus.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    segs = _initial_segments(corpus, n)
    if vocab.count:                # what an earlier run left out at its cap may still come
        segs = _replaced(segs, vocab.pack(), repeat=True, changed_only=False).filter(F.size("codes") >= n)
    segs = save_scratch(segs, "segments")
    report = []
    rnd, newest = 0, None
    while not vocab.full and (max_rounds is None or rnd < max_rounds):
        t0 = time.time()
        cap_left = vocab.vocab_size - vocab.count
        vocab_texts = vocab.to_df(spark).select("unrolled")
        # round 0 needs no windows to know their number
        counted = (F.greatest(F.size("codes") - n + 1, F.lit(0)) if newest is None
                   else F.size(_counted(nseq_windows(F.col("codes"), n), newest)))
        windows = segs.agg(F.coalesce(F.sum(counted.cast("long")), F.lit(0))).first()[0]
        chosen = round_candidates(segs, vocab_texts, n, cap_left, newest).collect() if windows else []
        newest = TOK_ID_OFFSET + vocab.next_free_id
        for row in chosen:
            vocab.add(tuple(row["comps"]), row["unrolled"])
        segs_left = 0
        if chosen and not vocab.full:
            old = segs
            segs = save_scratch(_replaced(segs, vocab.pack(newest)).filter(F.size("codes") >= n), "segments")
            drop_scratch(old)
            segs_left = segs.count()
        report.append((rnd, len(chosen), vocab.count, vocab.full, segs_left, windows,
                       int(input_bytes), len(chosen) / input_bytes if input_bytes else 0.0,
                       time.time() - t0))
        rnd += 1
        if not chosen:
            break
    drop_scratch(segs)
    return vocab, spark.createDataFrame(report, REPORT_SCHEMA)


def _replaced(segs: DataFrame, table: packed.Packed, repeat: bool = False, changed_only: bool = True) -> DataFrame:
    """``segs(freq, codes, parts)`` after one pass of ``table`` (``repeat``: passes until nothing changes)."""
    spark = segs.sparkSession
    ensure_worker_import(spark)
    bc = spark.sparkContext.broadcast(table)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = packed.flat_lists(batch.column("codes"))
            codes, parts = flat.to_numpy(zero_copy_only=False), batch.column("parts").flatten()
            size, near = np.diff(offs), None
            while (done := packed.one_pass(codes, offs, bc.value, near)) is not None:
                codes, offs, keep, near = done
                # a token's part is the parts that it replaces, joined
                groups = np.append(np.flatnonzero(keep), len(keep)).astype(np.int32)
                parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups), parts), "")
                if not repeat:
                    break
            out = pa.RecordBatch.from_arrays(
                [batch.column("freq"), packed.list_column(codes, offs), packed.list_column(parts, offs)],
                names=["freq", "codes", "parts"])
            yield out.filter(pa.array(np.diff(offs) != size)) if changed_only else out

    return segs.select("freq", "codes", "parts").mapInArrow(fn, "freq bigint, codes array<bigint>, parts array<string>")


# ---------------------------------------------------------------------------
# Resolution and validation of vocabulary tables whose entries reference others.

def validate_vocab(entries: DataFrame, n: int) -> DataFrame:
    """Violation rows ``(code, problem)`` of an ``(code, comps)`` table.

    Problems: undefined component token, component that is not a Unicode scalar
    value (surrogate or negative), wrong arity, code below the token range, and entries that
    cannot be spelled out because they are on a cycle of references or refer to one.
    """
    low = (entries.filter(F.col("code") < TOK_ID_OFFSET)
           .select("code", F.lit("code below the token range").alias("problem")))
    comps = entries.select("code", F.explode("comps").alias("c"))
    undefined = (_undefined(entries)
                 .select("code", F.concat(F.lit("undefined component "), F.col("c")).alias("problem")))
    not_scalar = (comps.filter(((F.col("c") >= 0xD800) & (F.col("c") <= 0xDFFF)) | (F.col("c") < 0))
                  .select("code", F.concat(F.lit("not a unicode scalar "), F.col("c")).alias("problem")))
    arity = (entries.filter(F.size("comps") != n)
             .select("code", F.concat(F.lit("arity "), F.size("comps")).alias("problem")))
    cyclic = cyclic_entries(entries).select("code", F.lit("on or behind a cycle").alias("problem"))
    return undefined.unionByName(not_scalar).unionByName(arity).unionByName(low).unionByName(cyclic)


def _undefined(entries: DataFrame) -> DataFrame:
    """(code, c) of each component token without an entry."""
    comps = entries.select("code", F.explode("comps").alias("c")).filter(F.col("c") >= TOK_ID_OFFSET)
    return comps.join(entries.select(F.col("code").alias("c")), "c", "left_anti").select("code", "c")


def cyclic_entries(entries: DataFrame) -> DataFrame:
    """``(code)`` of the entries on a cycle of references or behind one (referring to it at any depth).

    A valid vocabulary takes the log2(depth) rounds of the doubling; only what that cannot finish is
    peeled: entries all of whose references are gone go, round by round, until none goes.
    """
    spelt = _doubled(_first_pieces(entries), int(entries.count()))
    left = spelt.filter(_has_ref(F.col("pieces"))).select("code")
    if left.isEmpty():
        return left
    refs = entries.join(left, "code", "left_semi").select("code", F.explode("comps").alias("c"))
    # undefined components are another problem: they hold nothing back
    refs = save_scratch(refs.join(left.withColumnRenamed("code", "c"), "c", "left_semi").select("code", "c").distinct(), "refs")
    while True:
        kept = save_scratch(refs.join(refs.select(F.col("code").alias("c")).distinct(), "c", "left_semi").select("code", "c"), "refs")
        fewer = kept.count() < refs.count()
        drop_scratch(refs)
        refs = kept
        if not fewer:
            return refs.select("code").distinct()


_PIECES = "array<struct<text string, display string, ref bigint>>"

#: More pieces than this in one entry: taken for a cycle (or a token too long to spell out).
MAX_PIECES = 1 << 20


def _has_ref(pieces: Column) -> Column:
    return F.exists(pieces, lambda x: x["ref"].isNotNull())


def _first_pieces(entries: DataFrame) -> DataFrame:
    """(code, pieces): an entry as characters, marks of its display form, and references, in order."""
    piece = lambda text, display, ref: F.struct(text.alias("text"), display.alias("display"), ref.cast("bigint").alias("ref"))
    nothing, null = F.lit(""), F.lit(None)
    mark = lambda display: piece(nothing, display, null)
    comp = lambda c: F.when(c < TOK_ID_OFFSET, piece(code_to_text(c), code_to_text(c), null)).otherwise(piece(nothing, nothing, c))
    inner = F.flatten(F.transform("comps", lambda c, i: F.when(i == 0, F.array(comp(c))).otherwise(
        F.array(mark(F.lit("|")), comp(c)))))
    start = F.array(mark(F.concat((F.col("code") - TOK_ID_OFFSET).cast("string"), F.lit("=("))))
    return entries.select("code", F.concat(start, inner, F.array(mark(F.lit(")")))).cast(_PIECES).alias("pieces"))


def _doubled(now: DataFrame, n_entries: int, rounds: list[int] | None = None) -> DataFrame:
    """Every reference replaced by what its entry is by now, until none is left: round k reaches 2**k levels.

    An acyclic table of ``n_entries`` is at most that deep, so entries that still have references after
    log2(n_entries) rounds, or that grow beyond ``MAX_PIECES``, are given back unfinished.
    References to undefined entries count as spelled out (:func:`validate_vocab` reports them).
    """
    undefined = now.select(F.explode("pieces").alias("x")).select(F.col("x.ref").alias("ref")).filter("ref IS NOT NULL").distinct()
    undefined = undefined.join(now.select(F.col("code").alias("ref")), "ref", "left_anti").select(
        F.col("ref").alias("code"), F.array().cast(_PIECES).alias("pieces"))
    now = save_scratch(now.unionByName(undefined), "pieces")
    limit = max(1, (n_entries - 1).bit_length() + 1)
    for k in range(limit):
        open_ = now.filter(_has_ref(F.col("pieces")))
        table = now.select(F.col("code").alias("ref"), F.col("pieces").alias("sub"), F.size("pieces").alias("n"))
        parts = open_.select("code", F.posexplode("pieces").alias("pos", "x")).withColumn("ref", F.col("x.ref"))
        sizes = parts.join(table.select("ref", "n"), "ref", "left").groupBy("code").agg(
            F.sum(F.coalesce("n", F.lit(1)).cast("bigint")).alias("n"))
        most = sizes.agg(F.max("n")).first()[0]
        if most is None or most > MAX_PIECES:
            break
        met = parts.join(table.select("ref", "sub"), "ref", "left").select(
            "code", F.struct("pos", F.coalesce("sub", F.array("x")).alias("sub")).alias("s"))
        grown = met.groupBy("code").agg(F.sort_array(F.collect_list("s")).alias("s")).select(
            "code", F.flatten(F.transform("s", lambda s: s["sub"])).alias("pieces"))
        after = save_scratch(now.filter(~_has_ref(F.col("pieces"))).unionByName(grown), "pieces")
        drop_scratch(now)
        now = after
        if rounds is not None:
            rounds.append(k)
    return now.join(undefined.select("code"), "code", "left_anti")


def resolve_vocab(entries: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Compute ``unrolled`` and ``display`` for ``(code, comps)`` entries.

    Pointer doubling over the reference graph: an entry is an ordered list of texts and references, and a
    round puts each referenced entry's present list in its place, so depth d takes about log2(d) rounds.
    A cycle or an undefined component is an error.  ``rounds`` gets an element a round.
    """
    if not _undefined(entries).isEmpty():
        raise ValueError("vocabulary has unresolvable (undefined) entries")
    spelt = save_scratch(_doubled(_first_pieces(entries), int(entries.count()), rounds), "spelt")
    if not spelt.filter(_has_ref(F.col("pieces"))).isEmpty():
        raise ValueError("vocabulary has unresolvable (cyclic) entries")
    joined = lambda field: F.array_join(F.transform("pieces", lambda x: x[field]), "")
    return spelt.select("code", joined("text").alias("unrolled"), joined("display").alias("display"))


def vocab_legality(vocab_df: DataFrame) -> DataFrame:
    """Rows of entries whose text is not a legal token (imported vocabularies only)."""
    return vocab_df.filter(~legal(F.col("unrolled")))
