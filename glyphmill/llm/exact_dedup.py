"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step keeps only the groups that still hold two or more rows; the full text is hashed
only for rows that share both the length and the prefix hash with another row.  Which
(length, prefix hash) pairs these are goes to the second scan as a bit table of fixed size,
so that no text is shuffled; a row that shares its bit with a surviving pair is hashed too,
which costs time but cannot change a group.  The second scan numbers its rows and the group's
result is carried on them, so no row is found again by its id.  DataFrame functions only.
Texts are equal when identical after deleting ASCII white space; of equal texts the one with
the most code points, then the smallest ``doc_id``, stays.

Edge cases: a null text equals the empty text; one row in, one row out, and exactly one row
of a group is kept, also where ids are repeated or null; a null ``doc_id`` sorts first; an
empty table gives an empty result; other columns of the input are read only where ``more``
names them, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import SPACE, group_attributes, id_text, in_bit_table, null_safe_join, salt, save

#: Characters of the normalised text that the prefix hash covers.
PREFIX = 256


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE + "+", "")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _several(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` that two or more rows have."""
    return parts.groupBy(*keys).agg(F.sum("_n").alias("_n")).filter("_n > 1").drop("_n")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` another row has too; counts are pre-aggregated, hot keys salted."""
    salted = rows.withColumn("_salt", salt("_own"))
    parts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    wanted = null_safe_join(parts.drop("_n"), _several(parts, keys), keys)
    return null_safe_join(salted, wanted, [*keys, "_salt"], "left_semi").drop("_salt")


def exact_dedup(docs: DataFrame, digest: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, for every row of (doc_id, text).

    ``digest`` adds text_sha256, the SHA-256 of the normalised text; ``more`` names further
    columns of ``docs`` to carry along.
    """
    length, prefix = F.length("_norm"), F.xxhash64(F.substring("_norm", 1, PREFIX))
    narrow = save(id_text(docs).select(normalised().alias("_norm")).select(
        length.alias("len"), prefix.alias("prefix"), F.monotonically_increasing_id().alias("_own")), "exact-narrow")
    alike = _shared(narrow, ["len"]).withColumn("_n", F.lit(1))
    surviving = save(_several(alike, ["len", "prefix"]).select(F.xxhash64("len", "prefix").alias("_pair")),
                     "exact-surviving")
    texts = id_text(docs, *more).withColumn("_norm", normalised()).withColumn("_pair", F.xxhash64(length, prefix))
    full_hash = sha256_hex(F.col("_norm"))
    rows = save(in_bit_table(texts, surviving, "_pair", "_read").select(
        "doc_id", *more, "_read", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        (full_hash if digest else F.when(F.col("_read"), full_hash)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_own")), "exact-full")
    best = F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").alias("keep_id"), F.col("_own").alias("own"))
    grouped = group_attributes(rows.filter("_read"), ["text_sha256"], "_own",
                               {"_best": F.min(best), "group_size": F.count(F.lit(1))},
                               {"_best": F.min("_best"), "group_size": F.sum("group_size")})
    carried = [*(["text_sha256"] if digest else []), *more]
    return grouped.select(
        "doc_id", F.col("_best.keep_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("_own") == F.col("_best.own")).alias("kept"), *carried).unionByName(rows.filter("NOT _read").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), *carried))


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text (the query's digest column)."""
    return id_text(docs).select("doc_id", sha256_hex(normalised()).alias("text_sha256"))
