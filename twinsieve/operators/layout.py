"""A three-dimensional map: standardized vectors, three principal components, clusters drawn together."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.names import basename, stem
from twinsieve.functions.vectors import doubles, standardize

NOISE = "Noise/Unique"
#: How far centres and members are drawn apart, and others.
CENTRE, MEMBER, OTHER = 10.0, 30.0, 15.0
DEFAULT_QUALITY = 50.0


def project(df: DataFrame, key: str, vec: str, k: int = 3) -> DataFrame:
    """(key, x, y, z); fewer than k rows or dimensions give no rows. A component's largest loading is positive."""
    dims = df.select(F.size(vec).alias("d")).first()
    if dims is None or dims.d < k or df.limit(k).count() < k:
        return df.select(key, *[F.lit(0.0).alias(c) for c in "xyz"]).limit(0)
    z = standardize(df.select(key, doubles(F.col(vec)).alias(vec)), key, vec)
    rows = z.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    rows = rows.select(key, array_to_vector("v").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="p").fit(rows)
    load = model.pc.toArray()
    sign = [1.0 if col[abs(col).argmax()] > 0 else -1.0 for col in load.T]
    p = vector_to_array("p")
    return model.transform(rows).select(key, *[(F.get(p, F.lit(i)) * sign[i]).alias(c) for i, c in enumerate("xyz")])


def spread(points: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Members: centre * 10 + (point - centre) * 30; others: point * 15 -> (key, x, y, z, cluster)."""
    j = points.join(clusters.select(key, "cluster").dropDuplicates([key]), key, "left")
    centre = j.where("cluster is not null").groupBy("cluster").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    j = j.join(centre, "cluster", "left")
    at = lambda c: F.when(F.col("cluster").isNull(), F.col(c) * OTHER).otherwise(F.col(f"c{c}") * CENTRE + (F.col(c) - F.col(f"c{c}")) * MEMBER)
    return j.select(key, *[at(c).alias(c) for c in "xyz"], F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def records(points: DataFrame, files: DataFrame, quality: DataFrame) -> DataFrame:
    """``points(filename, x, y, z)``, ``files(path, cluster)``, ``quality(path, total)`` -> map records.

    A file's cluster and score are looked up by base name, then full path, then stem;
    what is not found is ``Noise/Unique`` and 50. Of paths that share a key the last counts.
    """
    p = points.withColumn("base", basename(F.col("filename"))).withColumn("stem", stem(F.col("filename")))
    for name, table, value in (("cluster", files, "cluster"), ("quality", quality, "total")):
        for key, of in (("base", basename(F.col("path"))), ("filename", F.col("path")), ("stem", stem(F.col("path")))):
            p = p.join(table.groupBy(of.alias(key)).agg(F.max_by(value, "path").alias(f"{name}_{key}")), key, "left")
    cluster = F.coalesce("cluster_base", "cluster_filename", "cluster_stem", F.lit(NOISE))
    path = F.when(cluster == NOISE, F.col("filename")).otherwise(F.concat_ws("/", cluster, "base"))
    return p.select("x", "y", "z", "filename", path.alias("path"), cluster.alias("cluster"), F.coalesce("quality_base", "quality_filename", "quality_stem", F.lit(DEFAULT_QUALITY)).alias("quality"))


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths(path)`` whose base name is that of one of ``files(filename)``."""
    return paths.join(files.select(basename(F.col("filename")).alias("_base")).distinct(), basename(F.col("path")) == F.col("_base"), "left_semi")


def member_rows(members: DataFrame, points: DataFrame) -> DataFrame:
    """``members(group_id, path)``, ``points(idx, filename)`` -> (group_id, path, idx): the row of a member by base name; of rows with the same name the last."""
    last = points.groupBy(basename(F.col("filename")).alias("_base")).agg(F.max("idx").alias("idx"))
    return members.join(last, basename(F.col("path")) == F.col("_base")).select("group_id", "path", "idx")


def score_of(members: DataFrame, scores: DataFrame) -> DataFrame:
    """``members(group_id, path)``, ``scores(group_id, path, total)`` -> with total: the score in the own group, else that in the first group by name which has the path."""
    own = scores.groupBy("group_id", "path").agg(F.max("total").alias("own"))
    elsewhere = scores.where("total is not null").groupBy("path").agg(F.min_by("total", "group_id").alias("other"))
    return members.join(own, ["group_id", "path"], "left").join(elsewhere, "path", "left").select("group_id", "path", F.coalesce("own", "other").alias("total"))
