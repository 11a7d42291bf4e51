"""Groups against classes: owners, precision, recall, F1, accuracy. Only the counts by group and class are used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.storage import settle


def confusion(members: DataFrame) -> DataFrame:
    """``members(group_id, class)`` -> (group_id, class, n)."""
    return members.groupBy("group_id", "class").agg(F.count("*").alias("n"))


def candidates(counts: DataFrame) -> DataFrame:
    """(class, place, group_id, n): the groups a class may own, by name.

    Those where the class is (one of) the most frequent, of these the ones with the
    class's highest count.
    """
    top = counts.withColumn("most", F.max("n").over(Window.partitionBy("group_id"))).where("n = most")
    best = top.withColumn("best", F.max("n").over(Window.partitionBy("class"))).where("n = best")
    return best.select("class", F.row_number().over(Window.partitionBy("class").orderBy("group_id")).alias("place"), "group_id", "n")


def owners(counts: DataFrame) -> DataFrame:
    """(class, group_id), one row per class, null without a group: first candidates; of several classes with
    the same first candidate the least keeps it, the others take their second candidate, if any, unseen."""
    c = candidates(counts)
    first = c.where("place = 1").withColumn("winner", F.min("class").over(Window.partitionBy("group_id")))
    second = c.where("place = 2").select("class", F.col("group_id").alias("next"))
    took = first.join(second, "class", "left").select("class", F.when(F.col("class") == F.col("winner"), F.col("group_id")).otherwise(F.col("next")).alias("group_id"))
    return counts.select("class").distinct().join(took, "class", "left")


def accuracy_owners(counts: DataFrame, rest: int = 1 << 20) -> DataFrame:
    """(class, group_id): classes in name order take their first free candidate; one after the first counts
    only if the class has there as many as it has anywhere.

    A round settles each class that is the least of those that list the group it would
    take, the least open one always. When at most ``rest`` candidates are left, one task
    goes through them.
    """
    anywhere = counts.groupBy("class").agg(F.max("n").alias("anywhere"))
    c = candidates(counts).join(anywhere, "class").where((F.col("place") == 1) | (F.col("n") == F.col("anywhere")))
    kinds = {n: c.schema[n].dataType.simpleString() for n in ("class", "group_id")}
    schema = f"class {kinds['class']}, group_id {kinds['group_id']}"
    open_ = settle(c.select("class", "place", "group_id"), "candidates")
    parts = []
    while open_.count() > rest:
        first = open_.groupBy("class").agg(F.min_by("group_id", "place").alias("group_id"))
        least = open_.groupBy("group_id").agg(F.min("class").alias("class"))
        took = settle(first.join(least, ["class", "group_id"]).select("class", "group_id"), "took")
        parts.append(took)
        open_ = settle(open_.join(took.select("class"), "class", "left_anti").join(took.select("group_id"), "group_id", "left_anti").select("class", "place", "group_id"), "candidates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, taken = {}, set()
        rows = sorted(x for b in batches for x in zip(b["class"], b["place"], b["group_id"], strict=True))
        for name, _, group in rows:
            if name not in own and group not in taken:
                own[name] = group
                taken.add(group)
        if own:
            yield pd.DataFrame({"class": list(own), "group_id": list(own.values())})

    took = open_.coalesce(1).mapInPandas(run, schema)
    for part in parts:
        took = took.unionByName(part)
    return counts.select("class").distinct().join(took, "class", "left")


def class_scores(counts: DataFrame, own: DataFrame) -> DataFrame:
    """(class, group_id, total, predicted, correct, precision, recall, f1); a score is 0 where its denominator is."""
    total = counts.groupBy("class").agg(F.sum("n").alias("total"))
    size = counts.groupBy("group_id").agg(F.sum("n").alias("predicted"))
    hit = counts.select("class", "group_id", F.col("n").alias("correct"))
    r = total.join(own, "class", "left").join(size, "group_id", "left").join(hit, ["class", "group_id"], "left")
    r = r.select("class", "group_id", "total", F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("correct", F.lit(0)).alias("correct"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    r = r.withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn("recall", ratio(F.col("correct"), F.col("total")))
    return r.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("classes"))


def accuracy(counts: DataFrame) -> DataFrame:
    """(accuracy): percent of items that are in the group their class owns; 0 without items."""
    own = accuracy_owners(counts)
    r = counts.join(own.withColumnRenamed("group_id", "own"), "class", "left")
    hits = F.sum(F.when(F.col("group_id") == F.col("own"), F.col("n")).otherwise(0))
    return r.agg(F.coalesce(F.try_divide(hits * 100.0, F.sum("n")), F.lit(0.0)).alias("accuracy"))
