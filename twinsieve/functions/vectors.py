"""Vector and bit arithmetic as column expressions over ``array<double>`` and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distance of codes that cannot be compared.
INCOMPARABLE = 9999


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column, zero: str = "guard") -> Column:
    """Unit length. A zero vector: ``guard`` keeps it zero, ``nan`` gives NaN, ``keep`` leaves the input."""
    # A lambda works out what stands in it anew for each element, so the length comes as a list.
    lengths = F.array_repeat(norm(v), F.size(v))
    if zero == "nan":
        return F.zip_with(v, lengths, lambda x, n: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, n)))
    return F.zip_with(v, lengths, lambda x, n: x / F.when(n == 0, F.lit(1.0 if zero == "keep" else 1e-7)).otherwise(n))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit codes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_sum(a: Column, b: Column) -> Column:
    """Sum of the bit distances of two lists of codes."""
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda s, x: s + x)


def hamming_elements(a: Column, b: Column) -> Column:
    """Number of unequal elements; lists of different length are ``INCOMPARABLE``."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(INCOMPARABLE)).otherwise(d)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_away(x: Column) -> Column:
    """Rounds half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def half_even(x: Column, places: int = 2) -> Column:
    return F.bround(x, places)


def pack_low_first(bits: Column) -> Column:
    """Bit i of the result is element i (0 or 1)."""
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def pack_high_first(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def min_max_scale(df: DataFrame, key: str, vec: str, eps: float = 1e-10) -> DataFrame:
    """(x - min) / (max - min + eps) by dimension -> (key, dim, x). The bounds are as many rows as dimensions."""
    long = df.select(key, F.posexplode(doubles(F.col(vec))).alias("dim", "x"))
    bounds = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return long.join(F.broadcast(bounds), "dim").select(key, "dim", ((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo") + eps)).alias("x"))


def standardize(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Zero mean and unit population deviation by dimension -> (key, dim, x); a constant dimension is 0."""
    long = df.select(key, F.posexplode(doubles(F.col(vec))).alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise((F.col("x") - F.col("mu")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", z.alias("x"))
