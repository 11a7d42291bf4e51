"""A distance threshold from a histogram: its first valley, or a percentile."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kernel(sigma: float) -> list[float]:
    """Gaussian weights out to 4 sigma, of sum 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(hist: DataFrame, sigma: float = 1.5, whole: bool = True) -> DataFrame:
    """(distance, cnt) on unit steps -> with ``s``; edges are mirrored. ``whole`` drops what is behind the point."""
    w = kernel(sigma)
    r = len(w) // 2
    size = hist.agg(F.min("distance").alias("lo"), F.count("*").alias("len"))
    h = hist.crossJoin(F.broadcast(size))  # one row
    offsets = h.select("distance", "cnt", "lo", "len", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(x).alias("w")) for i, x in zip(range(-r, r + 1), w, strict=True)])).alias("k"))
    at = F.pmod(F.col("distance") - F.col("lo") + F.col("k.o"), 2 * F.col("len"))
    source = offsets.select("distance", F.col("k.w").alias("w"), F.col("k.o").alias("o"), (F.col("lo") + F.least(at, 2 * F.col("len") - 1 - at)).alias("from"))
    parts = source.join(F.broadcast(hist.select(F.col("distance").alias("from"), "cnt")), "from")
    # A fixed order of summation, so that the whole part never depends on chance.
    total = parts.groupBy("distance").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("o", (F.col("w") * F.col("cnt")).alias("x")))), F.lit(0.0), lambda s, p: s + p["x"]).alias("s"))
    return hist.join(total, "distance").select("distance", "cnt", (F.floor(F.col("s") + 1e-9).cast("double") if whole else F.col("s")).alias("s"))


def minima(smoothed: DataFrame) -> DataFrame:
    """Distances strictly below both neighbours at steps 1 and 2; the edges are clipped and never qualify."""
    w = Window.orderBy("distance")  # as many rows as there are distances
    lo = F.min("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first, last = F.first("s").over(w), F.last("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = {k: (F.coalesce(F.lag("s", k).over(w), first), F.coalesce(F.lead("s", k).over(w), last)) for k in (1, 2)}
    named = smoothed.select("distance", "s", lo.alias("least"), *[c.alias(f"{side}{k}") for k, pair in near.items() for side, c in zip("ab", pair, strict=True)])
    return named.where("s < a1 and s < b1 and s < a2 and s < b2").select("distance")


def percentile(hist: DataFrame, p: float = 0.1) -> DataFrame:
    """(threshold): the weighted, interpolated percentile, cut to a whole number."""
    return hist.where("cnt > 0").agg(F.percentile("distance", F.lit(p), F.col("cnt")).cast("int").alias("threshold"))


def valley(hist: DataFrame, sigma: float = 1.5, whole: bool = True, flat: bool = True, empty: int | None = 0) -> DataFrame:
    """(threshold), one row: the first valley; the second if the first is within 2 of the least distance; else the percentile.

    ``flat``: a histogram of fewer than two steps gives its least distance. No pairs give ``empty``.
    """
    found = minima(smooth(hist, sigma, whole)).agg(F.array_sort(F.collect_list("distance")).alias("at"))
    span = hist.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    one = found.crossJoin(span).crossJoin(percentile(hist))  # one row each
    first = F.when((F.get("at", F.lit(0)) < F.col("lo") + 2) & (F.size("at") > 1), F.get("at", F.lit(1))).otherwise(F.get("at", F.lit(0)))
    t = F.coalesce(first, F.col("threshold"))
    t = F.when(F.lit(flat) & (F.col("hi") - F.col("lo") < 2), F.col("lo")).otherwise(t)
    return one.select(F.when(F.col("lo").isNull(), F.lit(empty)).otherwise(t).cast("int").alias("threshold"))
