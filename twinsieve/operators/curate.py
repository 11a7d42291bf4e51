"""Edits of groups, (group_id, id), as functions from groups to groups; what is to be deleted is a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class UnknownGroup(LookupError):
    """The group to be edited does not exist."""


class UnknownSession(LookupError):
    """No items are stored under the session."""


def delete(groups: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups without these ids (empty ones vanish), and the manifest of ids that existed."""
    return groups.join(ids.select("id").distinct(), "id", "left_anti").select(*groups.columns), groups.join(ids.select("id").distinct(), "id", "left_semi").select("id").distinct()


def keep_one(groups: DataFrame, group_id: str, keep) -> tuple[DataFrame, DataFrame]:
    """The group becomes ``keep`` alone, even if that was no member; its other members are to be deleted."""
    inside = F.col("group_id") == group_id
    if groups.where(inside).isEmpty():
        raise UnknownGroup(group_id)
    kind = dict(groups.dtypes)
    one = groups.sparkSession.range(1).select(F.lit(group_id).cast(kind["group_id"]).alias("group_id"), F.lit(keep).cast(kind["id"]).alias("id"))
    return groups.where(~inside).select("group_id", "id").unionByName(one), groups.where(inside & (F.col("id") != keep)).select("id").distinct()


def delete_group(groups: DataFrame, group_id: str) -> tuple[DataFrame, DataFrame]:
    """Groups without this one, and its members; an unknown group changes nothing."""
    inside = F.col("group_id") == group_id
    return groups.where(~inside), groups.where(inside).select("id").distinct()


def move(groups: DataFrame, ids: DataFrame, target: str) -> DataFrame:
    """The ids leave all groups and join the target, which is made if new; ids are not checked to exist."""
    rest = groups.join(ids.select("id").distinct(), "id", "left_anti").select("group_id", "id")
    return rest.unionByName(ids.select("id").distinct().select(F.lit(target).alias("group_id"), "id"))


def rank(members: DataFrame, score: str = "total") -> DataFrame:
    """Adds ``place`` (1 is best: highest score, then least id) and ``is_best`` by group."""
    w = Window.partitionBy("group_id").orderBy(F.desc_nulls_last(score), "id")
    return members.withColumn("place", F.row_number().over(w)).withColumn("is_best", F.col("place") == 1)


def best(members: DataFrame, score: str = "total") -> DataFrame:
    """(group_id, id, score) of each group's best member, as one pre-aggregated maximum."""
    top = members.groupBy("group_id").agg(F.min(F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("s"), "id")).alias("m"))
    return top.select("group_id", "m.id", (-F.col("m.s")).alias(score))


def keep_best(members: DataFrame, score: str = "total") -> tuple[DataFrame, DataFrame]:
    """Each group keeps its best member; the others are the manifest."""
    top = best(members, score)
    return top.select("group_id", "id"), members.select("group_id", "id").join(top.select("group_id", "id"), ["group_id", "id"], "left_anti").select("id")
