"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame functions only.

A source's target over its size is the copies each of its documents should get: a whole part
for all, and a fraction.  Fractions are settled in pairs: two units hand mass, measured in
words, to each other until one is 0 or 1, by a draw that keeps both expectations, so that the
source's words stay put.  Units are dealt into blocks of bounded size; a block settles all
but one unit, from the largest document down, and the blocks' residual units go up a
reduction tree until one is left per source, which a last draw settles.

Edge cases: a null or blank text has size 0 and takes 0; a null source is a source of its own,
last in order; sources without words get target 0; repeated rows are documents of their own;
an empty table gives an empty result; further input columns are ignored.  Draws depend on
(seed, doc_id, size) alone, so reruns and other partitionings agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import WORD, id_text, null_safe_join, save

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 17
#: Units that meet in one block of the reduction tree (expected; blocks are dealt by hash).
FAN_IN = 256


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(*of: Column) -> Column:
    """A uniform number in [0, 1) from a hash of its arguments."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The table has one row a source.  Capped sources are those with the smallest cap per
    weight; the level that the rest share follows from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.row_number().over(by_name) - 1) % k + 1).cast("int"))
    # a source without words can take nothing and leaves its share to the rest
    t = sources.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(after))
    t = t.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    # the first source that is not capped sets the level of all that follow it
    t = t.withColumn("share", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(every))
    return t.select("source", "source_size",
                    F.when(F.col("capped"), F.col("cap"))
                    .otherwise(F.col("share") * F.col("w")).cast("double").alias("target"))


def _settle(units: Column) -> Column:
    """Fold pivotal steps over an ordered array of units (p, size, doc_id, draw).

    The accumulator carries the unsettled unit and the settled ones as (doc_id, copies).
    """
    unit = "struct<p:double,size:bigint,doc_id:bigint,u:double>"
    none = F.lit(None).cast(unit)
    start = F.struct(none.alias("open"), F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:bigint>>").alias("done"))

    def step(acc, x):
        a = acc["open"]
        size = lambda u: u["size"].cast("double")
        at = lambda u, p: F.struct(p.alias("p"), u["size"].alias("size"), u["doc_id"].alias("doc_id"),
                                   u["u"].alias("u")).cast(unit)
        gone = lambda u, copies: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"),
                                          F.lit(copies).cast("long").alias("extra"))
        give, take = a["p"] * size(a), (1.0 - x["p"]) * size(x)     # words a can give, x can take
        give_x, take_a = x["p"] * size(x), (1.0 - a["p"]) * size(a)
        d1, d2 = F.least(give, take), F.least(give_x, take_a)
        to_x = x["u"] < d2 / F.greatest(d1 + d2, F.lit(1e-300))     # expectations stay as they are
        opened = (F.when(to_x & (give <= take), at(x, x["p"] + d1 / size(x)))
                  .when(to_x, at(a, a["p"] - d1 / size(a)))
                  .when(give_x <= take_a, at(a, a["p"] + d2 / size(a)))
                  .otherwise(at(x, x["p"] - d2 / size(x))))
        settled = (F.when(to_x & (give <= take), gone(a, 0)).when(to_x, gone(x, 1))
                   .when(give_x <= take_a, gone(x, 0)).otherwise(gone(a, 1)))
        return F.when(a.isNull(), F.struct(x.cast(unit).alias("open"), acc["done"].alias("done"))) \
            .otherwise(F.struct(opened.alias("open"), F.concat(acc["done"], F.array(settled)).alias("done")))

    return F.aggregate(units, start, step)


def pivotal_round(units: DataFrame, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, extra 0/1) from (doc_id, size, grp, p): 0 < p < 1, sums kept per ``grp``.

    Level by level: blocks of about ``fan_in`` units of one group settle all but one unit.
    """
    out, level = None, 0
    units = units.select("doc_id", "size", "grp", "p")
    while True:
        counts = save(units.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), f"mix-count-{level}")
        largest = counts.agg(F.max("n")).first()[0] or 0
        last = largest <= 2 * fan_in
        blocks = F.lit(1) if last else F.ceil(F.col("n") / F.lit(fan_in))
        dealt = units.join(counts.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g")).select(
            "grp", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), blocks).alias("block"),
            F.struct("size", F.coalesce("doc_id", F.lit(-1)).alias("k"), "doc_id", "p",
                     draw(F.lit(seed), F.lit(level), F.lit("u"), F.col("doc_id"), F.col("size")).alias("u")).alias("x"))
        folded = dealt.groupBy("grp", "block").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("xs")).select(
            "grp", _settle(F.transform("xs", lambda x: F.struct(
                x["p"].alias("p"), x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["u"].alias("u")))).alias("r"))
        folded = save(folded, f"mix-level-{level}")
        settled = folded.select(F.explode("r.done").alias("d")).select("d.doc_id", "d.size", "d.extra")
        left = folded.select("grp", "r.open.doc_id", "r.open.size", "r.open.p")
        if last:
            # of a source's last unit a draw decides; rounding noise near 0 and 1 settles itself
            final = left.select("doc_id", "size", (draw(
                F.lit(seed), F.lit("last"), F.col("doc_id"), F.col("size")) < F.col("p")).cast("long").alias("extra"))
            settled = settled.unionByName(final)
        out = settled if out is None else out.unionByName(settled)
        if last:
            return out
        units, level = left, level + 1


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of (doc_id, text, source)."""
    sized = save(id_text(docs, "source").select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # one row a source, written so that its real size decides how it is joined
    plan = save(targets.withColumn("grp", F.xxhash64("source", F.col("source").isNull()))
                .withColumn("whole", F.floor(rate + F.lit(1e-12)).cast("long"))
                .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0))), "mix-targets")
    rows = null_safe_join(sized, plan, ["source"])
    units = rows.filter("size > 0 AND p > 1e-12").select("doc_id", "size", "grp", "p")
    extra = pivotal_round(units, seed)
    # a repeated (doc_id, size) row is several units, told apart by number
    numbered = rows.withColumn("_hit", (F.col("size") > 0) & (F.col("p") > 1e-12))
    pairs = extra.withColumn("_i", F.row_number().over(
        Window.partitionBy("doc_id", "size").orderBy(F.col("extra").desc()))).withColumnRenamed("extra", "_e")
    joined = null_safe_join(numbered.withColumn("_i", F.row_number().over(
        Window.partitionBy("doc_id", "size", "_hit").orderBy("source"))), pairs.withColumn("_hit", F.lit(True)),
        ["doc_id", "size", "_hit", "_i"], "left")
    copies = F.col("whole") + F.coalesce("_e", F.lit(0))
    return joined.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))
