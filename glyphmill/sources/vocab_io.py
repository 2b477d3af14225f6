"""Vocabulary files: JSON export/import (S05, S06) and the parquet table form.

JSON layout (same keys as the reference's export)::

    {"n": 2, "vocab_size": 2, "tokens": {"1114112": [98, 108], "1114113": [108, 97]}}

``tokens`` maps the offset code of each token to its component codes.  The map is
built with one ``collect_list`` over the vocabulary table, which has at most
``vocab_size`` rows (a bounded group), and written as a single text file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.vocab import Vocab, resolve_vocab, validate_vocab, vocab_legality
from glyphmill.sources.corpus import check_output

EXPORT_SCHEMA = T.StructType([
    T.StructField("n", T.IntegerType()),
    T.StructField("vocab_size", T.LongType()),
    # from_json needs STRING map keys; codes are cast after the explode
    T.StructField("tokens", T.MapType(T.StringType(), T.ArrayType(T.LongType()))),
])


def vocab_json(vocab_df: DataFrame, n: int, vocab_size: int) -> DataFrame:
    """One-row DataFrame ``json STRING`` with the export document."""
    tokens = F.map_from_entries(F.collect_list(
        F.struct(F.col("code").cast("string"), F.col("comps"))))
    doc = vocab_df.agg(tokens.alias("tokens")).select(
        F.to_json(F.struct(F.lit(n).alias("n"), F.lit(vocab_size).cast("bigint").alias("vocab_size"),
                           F.coalesce("tokens", F.create_map().cast("map<string,array<bigint>>"))
                           .alias("tokens"))).alias("json"))
    return doc


def export_vocab(vocab: Vocab, path: str, mode: str = "errorifexists") -> None:
    """S05 (+S07): write the vocabulary JSON (one text file) and refuse to overwrite."""
    spark = SparkSession.getActiveSession()
    check_output(spark, path, mode)
    vocab_json(vocab.to_df(spark), vocab.n, vocab.vocab_size).coalesce(1).write.mode(
        mode).text(path)


def export_vocab_table(vocab: Vocab, path: str, mode: str = "errorifexists") -> None:
    """The table form: parquet ``(code, id, comps, unrolled)``; the writer's mode guards the path."""
    vocab.to_df(SparkSession.getActiveSession()).write.mode(mode).parquet(path)


def import_vocab_table(spark: SparkSession, path: str, n: int, vocab_size: int) -> Vocab:
    """The vocabulary of a parquet table ``(code, comps)``, validated and resolved like the JSON form."""
    return _validated(spark, spark.read.parquet(path).select("code", "comps"), n, vocab_size)


def read_vocab_entries(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Parse an export file into ``(code, comps)`` rows plus ``n`` and ``vocab_size``."""
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", EXPORT_SCHEMA).alias("d")).select("d.*")
    head = doc.select("n", "vocab_size").first()
    entries = doc.select(F.explode("tokens").alias("k", "comps")).select(
        F.col("k").cast("bigint").alias("code"), "comps")
    return entries, int(head["n"]), int(head["vocab_size"])


def import_vocab(spark: SparkSession, path: str) -> Vocab:
    """S06 + T15/T16: read, validate, resolve texts, and build a :class:`Vocab`.

    Raises ``ValueError`` listing violations (undefined component, non-scalar
    component, wrong arity).  ``next_free_id`` becomes ``max(id) + 1``.
    """
    return _validated(spark, *read_vocab_entries(spark, path))


def _validated(spark: SparkSession, entries: DataFrame, n: int, vocab_size: int) -> Vocab:
    bad = validate_vocab(entries, n).limit(20).collect()
    if bad:
        raise ValueError("invalid vocabulary: " + "; ".join(
            f"{r['code']}: {r['problem']}" for r in bad))
    resolved = resolve_vocab(entries)
    rows = entries.join(resolved, "code").collect()   # bounded by vocab_size
    v = Vocab(n=n, vocab_size=vocab_size)
    for r in sorted(rows, key=lambda r: r["code"]):
        v.put(int(r["code"]), tuple(int(c) for c in r["comps"]), r["unrolled"])
    # Segment-wise encoding is exact only for legal entries (see codec).
    v.all_legal = vocab_legality(resolved).isEmpty()
    return v
