"""Families of compact codes: sign projections, banded sign projections, thresholded
least projections and IDF-weighted similarity hashes.

A family is fitted on the driver from a seed, or from per-dimension statistics that are
as many rows as there are dimensions, and applied to vectors in Arrow batches as one
matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.functions.murmur import x64_128
from twinsieve.storage import settle

TINY = 1e-9


def planes(count: int, dim: int, seed: int, places: int = 6) -> np.ndarray:
    """Unit normal vectors of random hyperplanes, rounded so that they can be written down."""
    h = np.random.default_rng(seed).standard_normal((count, dim))
    length = np.linalg.norm(h, axis=1, keepdims=True)
    return np.round(h / np.where(length == 0, 1e-12, length), places)


def _matrix(s: pd.Series, dim: int) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in s]) if len(s) else np.zeros((0, dim))
    if x.shape[1] != dim:
        raise ValueError(f"vectors of length {x.shape[1]}; the family is for {dim}")
    return x


@dataclass(frozen=True)
class SignProjection:
    """Bit i of the code: the vector lies on the positive side of plane i. 1 to 64 planes."""

    count: int = 32
    dim: int = 2048
    seed: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.count <= 64:
            raise ValueError("1 to 64 planes")

    @property
    def planes(self) -> np.ndarray:
        return planes(self.count, self.dim, self.seed)

    def code(self, vec: str | Column) -> Column:
        h, dim = self.planes, self.dim
        weight = np.uint64(1) << np.arange(len(h), dtype=np.uint64)

        @F.pandas_udf("long")
        def run(s: pd.Series) -> pd.Series:
            bits = _matrix(s, dim) @ h.T > 0
            return pd.Series((bits * weight).sum(axis=1, dtype=np.uint64).astype(np.int64))

        return run(vec)


@dataclass(frozen=True)
class BandedProjection:
    """``bands`` codes of ``count // bands`` planes each; planes left over are unused, too few give zeros."""

    count: int = 64
    dim: int = 2048
    bands: int = 4
    seed: int = 0

    @property
    def planes(self) -> np.ndarray:
        return planes(self.count, self.dim, self.seed)

    def codes(self, vec: str | Column) -> Column:
        h, per, bands, dim = self.planes, self.count // self.bands, self.bands, self.dim
        if per > 64:
            raise ValueError("at most 64 planes a band")
        weight = np.uint64(1) << np.arange(per, dtype=np.uint64)

        @F.pandas_udf("array<long>")
        def run(s: pd.Series) -> pd.Series:
            bits = (_matrix(s, dim) @ h.T > 0)[:, : per * bands].reshape(len(s), bands, per)
            return pd.Series(list((bits * weight).sum(axis=2, dtype=np.uint64).astype(np.int64)))

        return run(vec)


@dataclass(frozen=True)
class LeastProjection:
    """Value j: the least product of component j with the planes' components j; its bit: above the mean
    of the dimension, or not below the median. Only the extreme planes of a dimension matter."""

    count: int = 128
    dim: int = 2048
    seed: int = 0

    @property
    def extremes(self) -> tuple[np.ndarray, np.ndarray]:
        h = planes(self.count, self.dim, self.seed)
        return h.min(axis=0), h.max(axis=0)

    def values(self, df: DataFrame, key: str, vec: str) -> DataFrame:
        """(key, dim, v)"""
        low, high = (F.array(*map(F.lit, x.tolist())) for x in self.extremes)
        long = df.select(key, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
        at = F.col("dim") + 1
        return long.select(key, "dim", (F.col("x") * F.when(F.col("x") >= 0, F.element_at(low, at)).otherwise(F.element_at(high, at))).alias("v"))

    def fit(self, values: DataFrame) -> DataFrame:
        """(dim, mean, median, stddev): one row per dimension."""
        plain = values.groupBy("dim").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(1e-12)).alias("stddev"))
        return plain.join(medians(values), "dim").select("dim", "mean", "median", "stddev")

    def signatures(self, values: DataFrame, stats: DataFrame, key: str, use_median: bool = False) -> DataFrame:
        """(key, bits): a 0 or 1 for each dimension."""
        bit = F.col("v") >= F.col("median") if use_median else F.col("v") > F.col("mean")
        long = values.join(F.broadcast(stats), "dim").select(key, "dim", bit.cast("tinyint").alias("bit"))
        return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "bit"))), lambda x: x["bit"]).alias("bits"))


def medians(values: DataFrame, bins: int = 1024, few: int = 4096) -> DataFrame:
    """``values(dim, v)`` -> (dim, median), exact: the mean of the two middle values.

    Rounds of counts in bins narrow the range that holds each of the two, until it is
    one value or holds a few rows; no state holds a dimension's values.
    """
    ends = values.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    two = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    open_ = settle(ends.select("dim", "lo", "hi", "n", two.alias("k")).distinct(), "ranks")  # two rows a dimension at most
    done = []
    while True:
        done.append(open_.where("lo = hi").select("dim", F.col("lo").alias("v")))
        last = open_.where("lo < hi").withColumn("last", F.col("n") <= few)
        wide = last.where("not last")
        inside = values.join(F.broadcast(last), "dim").where("v >= lo and v <= hi")
        rank = F.row_number().over(Window.partitionBy("dim", "k").orderBy("v"))  # at most a few rows
        done.append(inside.where("last").withColumn("r", rank - 1).where("r = k").select("dim", "v"))
        if wide.isEmpty():
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        counted = inside.where("not last").groupBy("dim", "k", at.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("dim", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bin
        open_ = settle(counted.withColumn("before", before).where("k >= before and k < before + n").select("dim", "lo", "hi", "n", (F.col("k") - F.col("before")).alias("k")), "ranks")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.groupBy("dim").agg(F.avg("v").alias("median"))


def packed(bits: Column) -> Column:
    """Bits as words of 64, first bit lowest."""
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 64).cast("int"))
    word = lambda w: F.aggregate(F.reverse(F.slice(bits, w * 64 + 1, F.lit(64))), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
    return F.transform(words, word)


@dataclass(frozen=True)
class SimilarityHash:
    """Sum over dimensions of +-1 patterns of a token times value times IDF; the signs are the code.

    A token is the dimension with the value rounded half away from zero, so for unit
    vectors there are four a dimension: -1, -0, 0 and 1. Of more than 64 bits the last
    64 are the code. A sum of exactly 0 gives bit 1.
    """

    bits: int = 128
    dim: int = 2048

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 128:
            raise ValueError("1 to 128 bits")

    @property
    def used(self) -> range:
        return range(max(0, self.bits - 64), self.bits)

    def patterns(self) -> np.ndarray:
        """[dimension, token, accumulator]: +-1 for the tokens -1, -0, 0, 1."""
        out = np.empty((self.dim, 4, len(self.used)))
        for d in range(self.dim):
            for t, rounded in enumerate((-1.0, -0.0, 0.0, 1.0)):
                words = x64_128(f"{d}:{rounded:.9f}".encode())
                out[d, t] = [1 if words[j // 64] >> (j % 64) & 1 else -1 for j in self.used]
        return out

    @staticmethod
    def fit(df: DataFrame, vec: str) -> DataFrame:
        """(dim, idf): ln(N / (1 + rows whose component exceeds 1e-9)); may be negative."""
        long = df.select(F.posexplode(vec).alias("dim", "x"))
        return long.groupBy("dim").agg(F.ln(F.count("*") / (1 + F.count_if(F.col("x").cast("double") > TINY))).alias("idf"))

    def code(self, vec: str | Column, idf: DataFrame) -> Column:
        """idf: a row per dimension, so it comes to the driver whatever the input."""
        rows = idf.collect()
        weight = np.zeros(self.dim)
        for r in rows:
            weight[r["dim"]] = r["idf"]
        table, dim = self.patterns(), self.dim

        @F.pandas_udf("long")
        def run(s: pd.Series) -> pd.Series:
            x = _matrix(s, dim)
            if len(x) and np.abs(x).max() >= 1.5:
                raise ValueError("unit vectors are expected")
            w = x * weight
            w[np.abs(w) < TINY] = 0
            token = np.where(np.abs(x) >= 0.5, np.where(x > 0, 3, 0), np.where(np.signbit(x), 1, 2))
            total = np.zeros((len(x), table.shape[2]))
            for t in range(4):
                total += np.where(token == t, w, 0) @ table[:, t]
            code = np.zeros(len(x), np.uint64)
            for j in range(total.shape[1]):
                code = (code << np.uint64(1)) | (total[:, j] >= 0).astype(np.uint64)
            return pd.Series(code.astype(np.int64))

        return run(vec)
