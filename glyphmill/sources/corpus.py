"""Corpus scans and row-level sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str | list[str], text_col: str = "text",
                key_col: str | list[str] = "doc_id", nulls: str = "skip") -> DataFrame:
    """Scan only the key and text columns of a parquet corpus.

    ``nulls='skip'`` drops null texts (pushed to the scan as ``IsNotNull``);
    ``nulls='stop'`` keeps only rows ordered before the first null text, the way a
    trainer that stops at the first missing text would see the table.
    Output columns: the key column(s) and ``text``.
    """
    keys = [key_col] if isinstance(key_col, str) else list(key_col)
    df = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*keys, F.col(text_col).alias("text"))
    return apply_nulls(df, keys, nulls)


def apply_nulls(df: DataFrame, keys: list[str], nulls: str) -> DataFrame:
    if nulls == "skip":
        return df.filter(F.col("text").isNotNull())
    if nulls == "stop":
        if len(keys) != 1:
            raise ValueError("nulls='stop' needs a single ordering key")
        key = keys[0]
        # The first null's key is a one-value scalar subquery (planned once, inlined
        # as a literal into the filter), so the corpus itself is not shuffled.
        stop_at = df.filter(F.col("text").isNull()).agg(F.min(key)).scalar()
        return df.filter(F.col("text").isNotNull() & (stop_at.isNull() | (F.col(key) < stop_at)))
    raise ValueError(f"nulls must be 'skip' or 'stop', not {nulls!r}")


def text_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """S03/T18 input sizes: rows, null texts, code points and UTF-8 bytes."""
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count("text").alias("n_text"),
        F.sum(F.length("text")).alias("n_chars"),
        F.sum(F.octet_length("text")).alias("n_bytes"),
    ]
    return df.groupBy(*(by or [])).agg(*aggs)


def seeded_hash_key(seed: int | str, *cols: Column | str) -> Column:
    """md5 of ``seed:col1:col2...`` -- a draw that is stable under repartitioning."""
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def seeded_uint32(seed: int | str, *cols: Column | str) -> Column:
    """First 32 bits of the seeded md5 as a non-negative BIGINT."""
    return F.conv(F.substring(seeded_hash_key(seed, *cols), 1, 8), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, seed: int, key_col: str = "doc_id") -> DataFrame:
    """Seeded sample of ``n`` rows without replacement.

    Planned as a TakeOrderedAndProject (per-partition top-n, then a merge of
    ``n * partitions`` rows) -- no full shuffle or sort of the table.
    """
    if n < 1:
        raise ValueError("sample size must be positive")
    return (df.withColumn("_draw", seeded_hash_key(seed, key_col))
            .orderBy("_draw", key_col).limit(n).drop("_draw"))


def check_output(spark: SparkSession, path: str, mode: str) -> None:
    """Refuse to replace an existing output unless ``mode='overwrite'``."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    if mode == "overwrite":
        return
    if path_exists(spark, path):
        raise FileExistsError(f"{path} exists; pass mode='overwrite' to replace it")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path``, in whichever file system the path names?"""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)
