"""Connected components by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum per node and an equi-join, so a node with
very many neighbours is one partial aggregate per task and a join partition that
adaptive execution can split. Nothing is collected but two totals per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.shared import settle


def _lower(edges: DataFrame) -> DataFrame:
    """Each edge as (hi, lo) with hi > lo, once."""
    return (
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi > lo")
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    near = e.join(least, "hi")
    return near.select(F.col("lo").alias("a"), F.col("m").alias("b")).union(near.select(F.col("hi").alias("a"), F.col("m").alias("b")).distinct())


def _totals(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node of an edge.

    ``component`` is the smallest node that can be reached. An empty input gives
    an empty result; self links and repeated links do no harm.
    """
    e = settle(_lower(edges), "cc", narrow=True)
    seen = _totals(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = settle(_lower(_small_star(_lower(_large_star(e)))), "cc", narrow=True)
        now = _totals(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
