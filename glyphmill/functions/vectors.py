"""Column expressions over ``ARRAY<FLOAT|DOUBLE>`` vectors.

All are higher-order SQL functions (``transform``/``aggregate``/``zip_with``), so
they stay in the JVM.  Formulas are kept exactly as the reference writes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (f32 constants).
F32_EPSILON = 1.1920929e-07
F32_MAX = 3.4028235e38
SMOL = F32_EPSILON * 10.0     # magnitudes at or below this are raised to it
BIGE = F32_MAX / 10.0         # magnitudes at or above this are lowered to it
GELU_K = 1.702                # sigmoid(1.702 x) approximation of GELU
# ---------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it as a lambda variable for ``body``.

    Spark does not share sub-expressions inside lambdas; without this a row
    statistic used per element would be recomputed for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clip_magnitude(x: Column) -> Column:
    """``|x| <= SMOL`` -> SMOL with x's sign (0 -> +, NaN -> +), ``|x| >= BIGE`` -> BIGE.

    NaN is tested explicitly: Spark orders NaN above every number.
    """
    small = F.when(F.isnan(x), F.lit(SMOL)).when(F.abs(x) > SMOL, x).otherwise(
        F.when(x < 0, F.lit(-SMOL)).otherwise(F.lit(SMOL)))
    return F.when(F.abs(small) < BIGE, small).otherwise(
        F.when(small < 0, F.lit(-BIGE)).otherwise(F.lit(BIGE)))


def softmax(v: Column) -> Column:
    """``clip(exp(v)) / clip(sum(exp(v)))`` -- no max subtraction; sum before clipping."""
    ex = F.transform(v, lambda a: F.exp(a.cast("double")))
    return let(ex, lambda e: let(
        clip_magnitude(F.aggregate(e, F.lit(0.0), lambda acc, a: acc + a)),
        lambda total: F.transform(e, lambda a: clip_magnitude(a) / total)))


def gelu(v: Column) -> Column:
    """``x * 1 / clip(1 + exp(-1.702 x))``."""
    return F.transform(v, lambda a: a.cast("double") * (
        F.lit(1.0) / clip_magnitude(F.lit(1.0) + F.exp(F.lit(-GELU_K) * a))))


def gelu_grad(v: Column) -> Column:
    """C02 as written: ``s = 1/clip(1 + exp(+1.702 x)); s * (1 + 1.702 x (1 - s))``."""
    def one(a):
        s = F.lit(1.0) / clip_magnitude(F.lit(1.0) + F.exp(F.lit(GELU_K) * a))
        return s * (F.lit(1.0) + F.lit(GELU_K) * a * (F.lit(1.0) - s))
    return F.transform(v, one)


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, a: acc + a.cast("double"))


def mean(v: Column) -> Column:
    """Row mean."""
    return vec_sum(v) / F.size(v)


def variance(v: Column) -> Column:
    """Population variance."""
    return let(mean(v), lambda mu: F.aggregate(
        v, F.lit(0.0), lambda acc, a: acc + (a - mu) * (a - mu)) / F.size(v))


def layer_norm(v: Column, scale: Column | None = None, bias: Column | None = None) -> Column:
    """C04 as written: ``x - mu / sqrt(var + SMOL)`` (only mu is divided), then scale, bias."""
    xhat = let(mean(v) / F.sqrt(variance(v) + F.lit(SMOL)),
               lambda shift: F.transform(v, lambda a: a.cast("double") - shift))
    if scale is None and bias is None:
        return xhat
    if scale is not None:
        xhat = F.zip_with(xhat, scale, lambda a, s: a * s)
    if bias is not None:
        xhat = F.zip_with(xhat, bias, lambda a, b: a + b)
    return xhat


def scale_vec(v: Column, c: Column | float) -> Column:
    """Multiply every element by ``c``."""
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.transform(v, lambda a: a.cast("double") * c)


def sum_squares(v: Column) -> Column:
    """M08 per row: sum of squares."""
    return F.aggregate(v, F.lit(0.0), lambda acc, a: acc + a.cast("double") * a.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, t: acc + t)


def count_nan(v: Column) -> Column:
    """Number of NaN elements."""
    return F.size(F.filter(v, lambda a: F.isnan(a)))


def count_inf(v: Column) -> Column:
    """Number of infinite elements."""
    return F.size(F.filter(v, lambda a: F.abs(a) == F.lit(math.inf)))


def weighted_checksum(v: Column) -> Column:
    """Order-sensitive digest of a vector: ``sum((pos + 1) * x)`` in double."""
    return F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)),
                                  lambda a, i: a.cast("double") * i),
                       F.lit(0.0), lambda acc, t: acc + t)
