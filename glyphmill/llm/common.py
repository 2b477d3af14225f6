"""Shared helpers of the training-data operators: table reads, scratch tables, skew-safe joins.

Scratch tables live in the shared folder that ``spark.checkpoint.dir`` names; nothing is
written to a machine-local folder.  A scratch table is read back with a known size, so
Catalyst broadcasts it only when it is really below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import drop_scratch as drop_saved  # noqa: F401
from glyphmill.session import save_scratch as save

#: ASCII white space of the contracts: space and tab .. carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Ways a hot key is spread before rows of the key are joined back to its group.
SALTS = 512

#: A bit table that picks rows in a scan: 256 pages of 32,768 bits, 1 MB at any input size.
PAGES = 256
PAGE_BITS = 32_768


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, *more: str) -> DataFrame:
    """Only (doc_id, text, *more): the operators never see other columns of the input."""
    return df.select("doc_id", "text", *more)


def residue(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus`` (null counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")),
                  F.lit(modulus))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: sizes the number of buckets so that each stays bounded."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def salt(column: str, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def group_attributes(rows: DataFrame, keys: list[str], spread: str, partial: dict, final: dict,
                     post: dict | None = None) -> DataFrame:
    """``rows`` with attributes of their group added, safe for a key that holds most rows.

    ``partial`` maps a name to an aggregate over (keys, salt of ``spread``), ``final`` a name
    to an aggregate over those.  The group's row is joined to its salted parts (at most SALTS
    rows a key) and these to the rows, so that no task gets a whole hot group.
    """
    salted = rows.withColumn("_salt", salt(spread))
    parts = salted.groupBy(*keys, "_salt").agg(*[c.alias(k) for k, c in partial.items()])
    whole = parts.groupBy(*keys).agg(*[c.alias(k) for k, c in final.items()])
    for name, c in (post or {}).items():
        whole = whole.withColumn(name, c)
    spread_out = null_safe_join(parts.select(*keys, "_salt"), whole, keys)
    return null_safe_join(salted, spread_out, [*keys, "_salt"]).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PAGES * PAGE_BITS))


def in_bit_table(rows: DataFrame, members: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with a flag: does a member's ``column`` have this row's bit?

    All members are flagged and some other rows; no row of ``rows`` is shuffled.
    """
    pages = members.select(_bit(column).alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bits"))
    placed = rows.withColumn("_b", _bit(column)).withColumn("_page", F.bitmap_bucket_number("_b"))
    spot = F.bitmap_bit_position("_b")
    byte = F.conv(F.hex(F.substring("_bits", (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # at most PAGES rows of 4 KB
    return placed.join(F.broadcast(pages), "_page", "left").withColumn(
        name, F.coalesce(F.getbit(byte, (spot % 8).cast("int")) == 1, F.lit(False))).drop("_b", "_page", "_bits")


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _row): all columns packed away, so that no helper column can clash with them."""
    return docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def own_ids(docs: DataFrame) -> DataFrame:
    """(_id, _row): the whole rows of ``docs``, a table scan, with an id that no other row has.

    ``_id`` is the ``doc_id`` where no other row has it; such rows are read from ``docs`` each time,
    not copied.  Rows with a null or repeated ``doc_id`` get a number above all ids, so that of equal
    rank a row with an id of its own comes first; they are saved with it (and the rows that share
    their bit with a repeated id), as the number depends on the scan.
    """
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    repeated = save(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    top, nulls = docs.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    rows = whole_rows(docs)
    if not nulls and repeated.isEmpty():
        return rows.select(F.col("doc_id").alias("_id"), "_row")
    marked = in_bit_table(rows.filter("doc_id IS NOT NULL"), repeated, "doc_id", "_flag")
    odd = marked.filter("_flag").join(repeated.withColumn("_several", F.lit(True)), "doc_id", "left").select(
        F.when(F.col("_several").isNull(), F.col("doc_id")).alias("_id"), "_row").unionByName(
        rows.filter("doc_id IS NULL").select(F.col("doc_id").alias("_id"), "_row"))
    fresh = F.lit(max(0, 0 if top is None else top + 1)) + F.monotonically_increasing_id()
    numbered = save(odd.select(F.coalesce("_id", fresh).alias("_id"), "_row"), "own-ids")
    return marked.filter("NOT _flag").select(F.col("doc_id").alias("_id"), "_row").unionByName(numbered)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``rows``, as ``own_ids`` gives them, less those whose ``_id`` is in ``dropped``;
    only rows that the bit table flags are shuffled, so a small share of the texts moves."""
    dropped = save(dropped.select("_id"), "dropped")
    marked = in_bit_table(rows, dropped, "_id", "_flag")
    clear = marked.filter(~F.col("_flag")).select("_row")
    return clear.unionByName(
        marked.filter("_flag").join(dropped, "_id", "left_anti").select("_row")).select("_row.*")
