"""A training corpus from raw documents: language ID, two dedups, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run``
writes each stage's rows as Parquet in the shared scratch folder and reads them again; what the
next stage has read is dropped.

Language ID learns from the documents themselves and drops what has no language.  Exact and
near dedup drop all but one row of each group, also where ids are repeated or null.  Mixing
repeats or drops documents so that sources meet their target weights, each row by a decision of
its own, whatever its id.  Packing cuts the mix into sequences.

Stages with Python workers bound their Arrow batches by bytes, for this session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import exact_dedup, langid, minhash, mixing, packing
from glyphmill.llm.common import documents, drop_saved, own_ids, residue, save, without
from glyphmill.llm.queries import tokenizer_path
from glyphmill.session import bound_batches


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null text, or no letter)."""
    bound_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs, residue("doc_id", 3) != 1))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one row stays: the longest, then the smallest doc_id."""
    rows = own_ids(docs)
    found = exact_dedup.exact_dedup(rows.select("_id", "_row.doc_id", "_row.text"), more=("_id",))
    return without(rows, found.filter("NOT kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays."""
    bound_batches(spark)
    rows = own_ids(docs)
    found = minhash.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "_row.text"))
    return without(rows, found.filter("NOT kept").select(F.col("doc_id").alias("_id")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = own_ids(docs)
    mixed = mixing.mix(rows.select(F.col("_id").alias("doc_id"), "_row.text", "_row.source"))
    copies = mixed.select(F.col("doc_id").alias("_id"), F.col("copies").cast("int").alias("_copies")).filter("_copies > 0")
    # a row a document: never small where it matters, so the same join at every size
    taken = rows.join(save(copies, "mix-copies").hint("merge"), "_id")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces in sequences of 4,096 tokens."""
    bound_batches(spark)
    return packing.pieces(packing.pack(docs, tokenizer_path()))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL cannot express the language model, the draws or the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"pipeline-{name}")
            if i:
                drop_saved(read)
    return docs
