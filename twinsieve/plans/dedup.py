"""The whole run: vectors to codes, threshold, groups; and the report with scores and map."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.vectors import doubles, normalize
from twinsieve.operators import curate, distances, grouping, knn, layout
from twinsieve.operators.hashing import BandedProjection, LeastProjection, SignProjection, SimilarityHash, packed
from twinsieve.operators.threshold import valley
from twinsieve.storage import settle

METHODS = ("sign_lsh", "banded_lsh", "min_projection", "simhash", "knn")


@dataclass
class Result:
    groups: DataFrame
    threshold: float | None
    seconds: dict[str, float] = field(default_factory=dict)


def _found(codes: DataFrame, sample: int | None) -> int:
    """The threshold of ``codes(id, codes)``, whose distance is the sum over the words of a code."""
    few = codes if sample is None else distances.sample(codes, sample)
    return valley(distances.histogram_of_sums(few.groupBy("codes").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))).first().threshold


def dedup(vectors: DataFrame, method: str, dim: int, threshold: float | None = None, keep_singletons: bool = True, k: int = 10, planes: int = 32, bands: int = 4, bits: int = 128, seed: int = 0, zero: str = "guard", sample: int | None = None) -> Result:
    """``vectors(id, vec)`` -> groups (id, leader, group_id, size).

    ``threshold`` is a similarity for ``knn``, else a distance; without one it is
    found from the histogram of the distances that the method groups by, over all pairs
    or over those of ``sample`` vectors. Without ``keep_singletons`` only groups of two
    or more remain.
    """
    if method not in METHODS:
        raise ValueError(f"method: one of {', '.join(METHODS)}")
    began = time.time()
    v = settle(vectors.select("id", normalize(doubles(F.col("vec")), zero).alias("vec")), "vectors")
    if method == "knn":
        threshold = 0.9 if threshold is None else threshold
        groups = grouping.components(v.select("id"), knn.edges(knn.nearest(v, k), threshold))
    elif method == "banded_lsh":
        codes = settle(v.select("id", BandedProjection(planes, dim, bands, seed).codes("vec").alias("codes")), "codes")
        threshold = _found(codes, sample) if threshold is None else threshold
        groups = grouping.leaders(codes, distances.banded_pairs(codes, int(threshold)))
    elif method == "min_projection":
        family = LeastProjection(planes, dim, seed)
        values = settle(family.values(v, "id", "vec"), "values")
        codes = settle(family.signatures(values, family.fit(values), "id").select("id", packed(F.col("bits")).alias("codes")), "codes")
        first = codes.groupBy("codes").agg(F.min("id").alias("first_id"))
        threshold = _found(codes, sample) if threshold is None else threshold
        near = distances.near_sums(first, int(threshold))
        lead = grouping.leaders(first.select(F.col("first_id").alias("id")), near)
        groups = codes.join(first, "codes").join(lead.withColumnRenamed("id", "first_id"), "first_id").select("id", "leader")
    else:
        code = SignProjection(planes, dim, seed).code("vec") if method == "sign_lsh" else SimilarityHash(bits, dim).code("vec", SimilarityHash.fit(v, "vec"))
        codes = settle(v.select("id", code.alias("code")), "codes")
        b = distances.buckets(codes)
        if threshold is None:
            few = b if sample is None else distances.buckets(distances.sample(codes, sample))
            threshold = valley(distances.histogram(few)).first().threshold
        width = planes if method == "sign_lsh" else min(64, bits)
        groups = grouping.groups_within(codes, int(threshold), width)
    groups = settle(groups, "groups")
    if not keep_singletons:
        groups = grouping.without_singletons(groups)
    out = grouping.named(groups, by_size=method == "knn")
    return Result(out, threshold, {"clustering": time.time() - began})


@dataclass
class Report:
    groups: DataFrame
    ranked: DataFrame
    points: DataFrame
    summary: DataFrame


def report(result: Result, scores: DataFrame, vectors: DataFrame) -> Report:
    """``scores(id, total)``, ``vectors(id, vec)`` -> lazy tables of groups, ranked members, map points and totals."""
    g = result.groups.select("group_id", "id")
    ranked = curate.rank(g.join(scores, "id", "left"))
    several = result.groups.where("size > 1").select("id", F.col("group_id").alias("cluster"))
    points = layout.spread(layout.project(vectors, "id", "vec"), several, "id")
    return Report(g, ranked, points.join(scores, "id", "left").withColumn("quality", F.coalesce("total", F.lit(layout.DEFAULT_QUALITY))).drop("total"), grouping.summary(result.groups))


def lines(result: Result, scores: DataFrame | None = None, correct: DataFrame | None = None) -> DataFrame:
    """The report in words, one row a line: (line). scores: macro measures; correct: accuracy, one row each."""
    number = lambda c, n=2: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    out = grouping.summary(result.groups.select("id", "leader")).select(F.explode(F.array(
        F.concat(F.lit("items: "), "total_items"), F.concat(F.lit("groups: "), "n_groups"), F.concat(F.lit("items in groups of several: "), "grouped_items"), F.concat(F.lit("items that could go: "), "redundant_items", F.lit(" ("), number("saved_percent"), F.lit(" %)")),
        *[F.lit(f"{k}: {v:.2f} s") for k, v in result.seconds.items()],
    )).alias("line"))
    if scores is not None:
        out = out.unionByName(scores.select(F.explode(F.array(*[F.concat(F.lit(f"{c}: "), number(c, 4)) for c in ("precision", "recall", "f1")])).alias("line")))
    if correct is not None:
        out = out.unionByName(correct.select(F.concat(F.lit("accuracy: "), number("accuracy"), F.lit(" %")).alias("line")))
    return out
