"""Whole-table vector steps of a gradient round.

Tables of vectors are keyed rows ``(keys..., vec ARRAY<DOUBLE>)``.  Element-wise
sums use the JVM ``Summarizer`` aggregate (partial + final ObjectHashAggregate),
so partial sums are combined map-side before the shuffle; norms are one
aggregate row read back as a scalar subquery, never a collect.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.vectors import clip_magnitude, scale_vec, sum_squares

PARAM_KEYS = ["tensor", "block", "row"]


def sum_vectors(df: DataFrame, keys: list[str], vec_col: str = "vec",
                out_col: str = "vec") -> DataFrame:
    """Element-wise sum of the vectors of each key (equal lengths per key)."""
    summed = (df.select(*keys, array_to_vector(F.col(vec_col)).alias("_v"))
              .groupBy(*keys).agg(Summarizer.sum(F.col("_v")).alias("_s")))
    return summed.select(*keys, vector_to_array(F.col("_s"), "float64").alias(out_col))


def scale_vectors(df: DataFrame, c: Column | float, vec_col: str = "vec") -> DataFrame:
    """Multiply every vector by ``c``."""
    return df.withColumn(vec_col, scale_vec(F.col(vec_col), c))


def global_sum_squares(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """One row ``sum_sq`` over every element of every vector."""
    return df.agg(F.coalesce(F.sum(sum_squares(F.col(vec_col))), F.lit(0.0)).alias("sum_sq"))


def global_l2_norm(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """One row ``norm``."""
    return global_sum_squares(df, vec_col).select(F.sqrt("sum_sq").alias("norm"))


def clip_coefficient(df: DataFrame, max_norm: float, vec_col: str = "vec") -> Column:
    """``max_norm / clip(norm)`` as a scalar-subquery column."""
    norm = global_l2_norm(df, vec_col).scalar()
    return F.lit(float(max_norm)) / clip_magnitude(norm)


def clip_by_norm(df: DataFrame, max_norm: float, vec_col: str = "vec") -> DataFrame:
    """Scale every vector by the coefficient when it is below 1."""
    # The coefficient is a scalar subquery; Spark does not allow one inside a
    # lambda, so it is bound to a column first and the lambda reads the column.
    staged = df.withColumn("_coeff", clip_coefficient(df, max_norm, vec_col))
    return staged.withColumn(
        vec_col, F.when(F.col("_coeff") < 1.0, scale_vec(F.col(vec_col), F.col("_coeff")))
        .otherwise(F.transform(vec_col, lambda a: a.cast("double")))).drop("_coeff")


def apply_update(params: DataFrame, grads: DataFrame, step: float,
                 keys: list[str] | None = None, vec_col: str = "vec") -> DataFrame:
    """``p <- p - g * step`` by key; rows without a gradient are unchanged.

    A left join on the parameter key: both sides are keyed by the same
    (tensor, block, row) and are co-partitioned by the join's shuffle.
    """
    keys = keys or PARAM_KEYS
    g = grads.select(*keys, F.col(vec_col).alias("_g"))
    joined = params.join(g, keys, "left")
    upd = F.when(F.col("_g").isNull(), F.transform(vec_col, lambda a: a.cast("double"))).otherwise(
        F.zip_with(vec_col, "_g", lambda p, q: p.cast("double") - q * F.lit(float(step))))
    return joined.withColumn(vec_col, upd).drop("_g")


def scatter_add(rows: DataFrame, index_col: str, vec_col: str = "vec",
                out_keys: list[str] | None = None) -> DataFrame:
    """Add vectors into rows selected by ``index_col`` (sparse: only rows seen)."""
    out = sum_vectors(rows, [index_col], vec_col)
    if out_keys:
        out = out.withColumnRenamed(index_col, out_keys[0])
    return out


def vector_validity(df: DataFrame, keys: list[str], vec_col: str = "vec") -> DataFrame:
    """Per key, number of vectors, NaN elements and infinite elements."""
    from glyphmill.functions.vectors import count_inf, count_nan
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vecs"),
        F.sum(count_nan(F.col(vec_col))).cast("bigint").alias("n_nan"),
        F.sum(count_inf(F.col(vec_col))).cast("bigint").alias("n_inf"))


def validate_vectors(df: DataFrame, keys: list[str], vec_col: str = "vec",
                     check_nan: bool = True, check_inf: bool = True) -> None:
    """Raise ``ValueError`` naming the keys whose vectors hold NaN and/or infinity.

    Only offending groups (at most 20) reach the driver.
    """
    v = vector_validity(df, keys, vec_col)
    cond = F.lit(False)
    if check_nan:
        cond = cond | (F.col("n_nan") > 0)
    if check_inf:
        cond = cond | (F.col("n_inf") > 0)
    bad = v.filter(cond).limit(20).collect()
    if bad:
        raise ValueError("non-finite values: " + "; ".join(
            f"{[r[k] for k in keys]}: {r['n_nan']} NaN, {r['n_inf']} inf" for r in bad))
