"""Corpus encode / decode against a vocabulary.

Encoding is a left-to-right, non-overlapping replacement of N-component windows
that are vocabulary entries, repeated until a pass replaces nothing.  The vocabulary is a
table ``(code, comps)`` (or the trainer's :class:`~glyphmill.operators.vocab.Vocab`).  Two plans:

* its packed array is below ``MAX_PACKED_BYTES``: the array is broadcast and the passes run over
  whole Arrow batches in ``mapInArrow`` (``operators.packed``), without a shuffle;
* it is larger: the distinct pieces of the corpus meet the vocabulary in a join a pass, and the
  encoded pieces go back to chunks of rows that hold them.

Documents are first cut into uncrossable segments by a JVM regex (see
``functions.text.SEGMENT_BODY``), so a word is encoded once a batch (or once at all) however
often it occurs.  Segmentation is only used when every vocabulary entry is a legal token (always
true for trained vocabularies); with an illegal entry the pieces are whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import TOK_ID_OFFSET, char_codes, nseq_windows, segments
from glyphmill.operators import packed
from glyphmill.session import drop_scratch, ensure_worker_import, save_scratch

#: A vocabulary whose packed array is larger is joined instead of broadcast (64 MB: 1.4 million pairs).
MAX_PACKED_BYTES = 64 << 20


#: Elements (pieces or codes) that a task handles at once; a longer row is handled alone.
SLICE_ELEMENTS = 1 << 18
#: Text of the rows that meet the codes of their pieces together; a longer text is alone or with its neighbours' rest.
CHUNK_BYTES = 16 << 20


def _slices(batch: pa.RecordBatch, source: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists hold at most SLICE_ELEMENTS elements together."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(source)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_ELEMENTS, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _mapped(df: DataFrame, bc, fn, source: str, out_col: str, keep: list[str]) -> DataFrame:
    """``out_col`` = ``fn(source column, packed vocabulary)`` beside the kept columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, source):
                cols = [rows.column(c) for c in keep] + [fn(rows.column(source), bc.value)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, out_col])
    return df.mapInArrow(run, _schema_with(df, keep, f"`{out_col}` array<bigint>"))


def decode_fn(bc, codes_col: str, out_col: str, keep: list[str]):
    """mapInArrow body: ``codes ARRAY<BIGINT>`` -> text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_texts(bc.value["texts"])
        for batch in batches:
            for rows in _slices(batch, codes_col):
                cols = [rows.column(c) for c in keep] + [decoded(rows.column(codes_col), *known)]
                yield pa.RecordBatch.from_arrays(cols, names=keep + [out_col])

    return run


def token_texts(texts: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vocabulary's codes in order, the code points of their texts one behind the other, and where each begins."""
    codes = np.array(sorted(texts), np.int64)
    return codes, *packed.char_codes(pa.array([texts[c] for c in codes.tolist()], pa.string()))


def decoded(column: pa.Array, codes: np.ndarray, points: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Texts of a list column of codes, without a Python object a code; a null list stays null."""
    flat, offs = packed.flat_lists(column)
    flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    token = flat >= TOK_ID_OFFSET
    at = np.searchsorted(codes, flat[token])
    if len(at) and not (len(codes) and (codes[np.minimum(at, len(codes) - 1)] == flat[token]).all()):
        raise KeyError("token code that the vocabulary lacks")
    sizes = np.ones(len(flat), np.int64)
    sizes[token] = np.diff(begins)[at]
    out = np.empty(int(sizes.sum()), np.int64)
    of_token = np.repeat(token, sizes)
    out[of_token] = packed.gather(points, begins, at)[0]
    out[~of_token] = flat[~token]
    texts = packed.texts_of(out, np.concatenate([[0], np.cumsum(sizes)])[offs])
    return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string())) if column.null_count else texts


def _schema_with(df: DataFrame, keep: list[str], extra: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
              if f.name in keep]
    return ", ".join(fields + [extra])


def pack_entries(entries: DataFrame, n: int) -> packed.Packed:
    """The packed array of a vocabulary table; the caller has checked its size."""
    found = entries.select("code", *[F.col("comps")[j].alias(f"c{j}") for j in range(n)]).toArrow()
    comps = np.stack([found.column(f"c{j}").to_numpy() for j in range(n)], axis=1) if found.num_rows else np.zeros((0, n))
    return packed.Packed(comps, found.column("code").to_numpy(), n)


def _pieces(df: DataFrame, text_col: str, by_segment: bool) -> DataFrame:
    text = F.col(text_col)
    return df.withColumn("_pieces", F.when(text.isNotNull(), segments(text) if by_segment else F.array(text)))


def encode(df: DataFrame, vocab, text_col: str = "text", out_col: str = "tokens", n: int | None = None,
           all_legal: bool | None = None, max_packed_bytes: int = MAX_PACKED_BYTES) -> DataFrame:
    """Add ``out_col ARRAY<BIGINT>`` = the encoded ``text_col`` (a null text stays null).

    ``vocab`` is a :class:`glyphmill.operators.vocab.Vocab` (map only, no shuffle) or a table
    ``(code, comps)`` of any size, joined where its packed array is above ``max_packed_bytes``.  For a table ``all_legal`` says whether every entry is a legal
    token; left out, it is found out from the table (its texts are resolved).
    """
    keep = [c for c in df.columns if c != out_col]
    spark = df.sparkSession
    ensure_worker_import(spark)
    if not isinstance(vocab, DataFrame):
        return _mapped(_pieces(df, text_col, vocab.all_legal), vocab.packed(spark), packed.encode_pieces, "_pieces", out_col, keep)
    entries = vocab.select("code", "comps")
    if all_legal is None:
        from glyphmill.operators.vocab import resolve_vocab, vocab_legality
        all_legal = vocab_legality(vocab if "unrolled" in vocab.columns else resolve_vocab(entries)).isEmpty()
    sizes = entries.agg(F.count(F.lit(1)), F.min(F.size("comps")), F.max(F.size("comps"))).first()
    n = n or sizes[2] or 2
    if sizes[0] and (sizes[1], sizes[2]) != (n, n):
        raise ValueError(f"entries of {sizes[1]} to {sizes[2]} components; the vocabulary is for {n}")
    if packed.packed_bytes(sizes[0], n) <= max_packed_bytes:
        bc = spark.sparkContext.broadcast(pack_entries(entries, n))
        return _mapped(_pieces(df, text_col, all_legal), bc, packed.encode_pieces, "_pieces", out_col, keep)
    return _encode_joined(df.select(*keep), entries, n, text_col, out_col, all_legal)


def _replace_hits(n: int):
    """mapInArrow body: rows (piece, codes, hits) -> codes with the hit windows replaced, leftmost first."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offs = packed.flat_lists(batch.column("codes"))
            hits, ends = packed.flat_lists(batch.column("hits"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            starts = hits.field("i").to_numpy(zero_copy_only=False) + offs[:-1][row]
            order = np.argsort(starts)
            found = hits.field("code").to_numpy(zero_copy_only=False)
            out, offs, _, _ = packed.replace(codes.to_numpy(zero_copy_only=False), offs, starts[order], found[order], n)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), packed.list_column(out, offs)], names=["piece", "codes"])
    return fn


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: ``_bytes`` -> ``_chunk``, a number for each run of rows with some CHUNK_BYTES of text."""
    base, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        at = batch.schema.get_field_index("_bytes")
        ends = before + np.cumsum(batch.column(at).to_numpy(), dtype=np.int64)
        chunk = base + np.concatenate([[before], ends[:-1]]) // CHUNK_BYTES
        before = int(ends[-1]) if len(ends) else before
        yield batch.set_column(at, "_chunk", pa.array(chunk, pa.int64()))


def _spelled(out_col: str, keep: list[str]):
    """Cogrouped body: a chunk's rows with ``_pieces``, and the codes of its distinct pieces -> the rows' codes."""
    def fn(rows: pa.Table, known: pa.Table) -> pa.Table:
        pieces = known.column("piece").combine_chunks()
        codes, ends = packed.flat_lists(known.column("codes").combine_chunks())
        codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for some in (s for batch in rows.to_batches() for s in _slices(batch, "_pieces")):
            held = some.column("_pieces")
            flat, offs = packed.flat_lists(held)
            coded = flat.dictionary_encode()
            at = pc.index_in(coded.dictionary, value_set=pieces)
            if at.null_count:
                raise ValueError("a piece of the text has no codes")
            which = at.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            values, piece_ends = packed.gather(codes, ends, which)
            tokens = packed.list_column(values, piece_ends[offs], held.is_valid())
            out.append(pa.RecordBatch.from_arrays([some.column(c) for c in keep] + [tokens], names=[*keep, out_col]))
        return pa.Table.from_batches(out)
    return fn


def _encode_joined(df: DataFrame, entries: DataFrame, n: int, text_col: str, out_col: str, by_segment: bool) -> DataFrame:
    """E02 for a vocabulary too large to broadcast: a join a pass over the distinct pieces.

    A piece leaves the loop when a pass replaces nothing in it.  After the first pass only windows with
    a token are looked up.  A chunk of rows meets each of its distinct pieces once, however many of its rows hold
    it, so what is shuffled is the texts and a dictionary a chunk, not a row a document and piece.
    """
    plain = df.columns
    sized = df.withColumn("_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    rows = save_scratch(sized.mapInArrow(_chunked, _schema_with(df, plain, "`_chunk` bigint")), "rows")
    each = _pieces(rows, text_col, by_segment).select("_chunk", F.explode(F.array_distinct("_pieces")).alias("piece"))
    held = save_scratch(each.distinct(), "pieces")
    active = save_scratch(held.select("piece").distinct(), "active")
    entries = save_scratch(entries, "entries")
    finished, first = [], True
    while True:
        codes = char_codes(F.col("piece")) if first else F.col("codes")  # a piece's own codes need not travel with it
        places = F.transform(nseq_windows(codes, n), lambda w, i: F.struct(i.alias("i"), w.alias("comps")))
        if not first:
            places = F.filter(places, lambda p: F.array_max(p["comps"]) >= TOK_ID_OFFSET)
        hits = (active.select("piece", F.explode(places).alias("p")).select("piece", "p.i", "p.comps")
                .join(entries, "comps").groupBy("piece").agg(F.collect_list(F.struct("i", "code")).alias("hits")))
        met = save_scratch(active.join(hits, "piece", "left").select("piece", codes.alias("codes"), "hits"), "met")
        drop_scratch(active)
        finished.append(met.filter("hits IS NULL").select("piece", "codes"))
        hit = met.filter("hits IS NOT NULL")
        if hit.isEmpty():
            break
        active, first = save_scratch(hit.mapInArrow(_replace_hits(n), "piece string, codes array<bigint>"), "active"), False
    encoded = finished[0]
    for more in finished[1:]:
        encoded = encoded.unionByName(more)
    known = held.join(encoded, "piece").select("_chunk", "piece", "codes").groupBy("_chunk")
    # texts are cut again behind the exchange, so that no piece travels with its row
    together = _pieces(rows.repartition("_chunk").sortWithinPartitions("_chunk"), text_col, by_segment)
    return together.groupBy("_chunk").cogroup(known).applyInArrow(
        _spelled(out_col, plain), _schema_with(df, plain, f"`{out_col}` array<bigint>"))


def reencode(df: DataFrame, vocab, codes_col: str = "tokens") -> DataFrame:
    """Re-encode already-encoded sequences with a (larger) vocabulary."""
    keep = [c for c in df.columns if c != codes_col]
    ensure_worker_import(df.sparkSession)
    return _mapped(df, vocab.packed(df.sparkSession), packed.encode_sequences, codes_col, codes_col, keep)


def decode(df: DataFrame, vocab, codes_col: str = "tokens", out_col: str = "text") -> DataFrame:
    """Turn code sequences back into text; ``decode(encode(t)) == t``."""
    keep = [c for c in df.columns if c != out_col]
    ensure_worker_import(df.sparkSession)
    bc = vocab.broadcast(df.sparkSession)
    fn = decode_fn(bc, codes_col, out_col, keep)
    return df.mapInArrow(fn, _schema_with(df, keep, f"`{out_col}` string"))


def token_counts(encoded: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Tokenized length per row (``size``), JVM-side."""
    return encoded.withColumn("n_tokens", F.size(tokens_col))


def model_vocab(encoded: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Dense model ids ``tok_idx`` 0..V-1 for every code seen, ordered by code.

    The distinct codes are at most (chars seen + vocab size) rows, so the single
    ordered ``row_number`` runs over a bounded table.  Of a text column the codes are its characters.
    """
    from pyspark.sql import Window
    if dict(encoded.dtypes)[tokens_col] == "string":
        ensure_worker_import(encoded.sparkSession)
        codes = encoded.select(F.col(tokens_col).alias("text")).mapInArrow(_char_sets, "code bigint").distinct()
        return codes.withColumn("tok_idx", F.row_number().over(Window.orderBy("code")) - 1)
    # de-duplicate inside each row first (codegen'd), so the explode emits at most
    # |distinct codes per row| rows instead of one per token position
    codes = (encoded.select(F.explode_outer(F.array_distinct(tokens_col)).alias("code"))
             .filter(F.col("code").isNotNull()).distinct())
    return codes.withColumn("tok_idx", F.row_number().over(Window.orderBy("code")) - 1)


def _char_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct code points of a task's texts."""
    seen = np.zeros(0x110000, bool)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            text = "".join(batch.column("text").slice(lo, 256).drop_null().to_pylist())
            seen[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["code"])


def map_tokens(df: DataFrame, ids: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Token arrays of codes -> arrays of dense model ids from ``ids(code, tok_idx)``, one map pass.

    ``ids`` has a row for each code seen (characters and vocabulary entries); a larger table than
    ``MAX_PACKED_BYTES`` is refused, and a code without an id is an error.
    """
    keep = [c for c in df.columns if c != tokens_col]
    ensure_worker_import(df.sparkSession)

    def mapped(column: pa.Array, known) -> pa.Array:
        flat, offs = packed.flat_lists(column)
        return packed.list_column(to_ids(flat.to_numpy(zero_copy_only=False).astype(np.int64), known), offs, column.is_valid())

    return _mapped(df, broadcast_ids(ids), mapped, tokens_col, tokens_col, keep)


def broadcast_ids(ids: DataFrame):
    """``ids(code, tok_idx)`` as two arrays in code order; a larger table than ``MAX_PACKED_BYTES`` is refused."""
    n_ids = ids.count()
    if 16 * n_ids > MAX_PACKED_BYTES:
        raise ValueError(f"{n_ids} model ids are more than one broadcast may hold")
    found = ids.select(F.col("code").cast("bigint"), F.col("tok_idx").cast("bigint")).toArrow().sort_by("code")
    return ids.sparkSession.sparkContext.broadcast((found.column("code").to_numpy(), found.column("tok_idx").to_numpy()))


def to_ids(flat: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Model ids of codes; a code without one is an error."""
    codes, idx = known
    at = np.minimum(np.searchsorted(codes, flat), max(0, len(codes) - 1))
    if len(flat) and not (len(codes) and (codes[at] == flat).all()):
        raise ValueError("token code without a model id")
    return idx[at] if len(flat) else flat
