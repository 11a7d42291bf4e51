"""Image folders, feature tables and uploads as DataFrames with stable keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.names import basename, is_image, safe_name
from twinsieve.operators.curate import UnknownSession

GLOB = "*.{jpg,JPG,Jpg,jpeg,JPEG,Jpeg,png,PNG,Png}"


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path, image) of a flat folder; a file that cannot be decoded has height -1."""
    df = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", GLOB).load(folder)
    return df.select(basename(F.col("image.origin")).alias("filename"), F.col("image.origin").alias("path"), "image")


def files(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """(path, filename, group_id): image files by name only; ``nested`` also those of subfolders, which name the group."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower()).load(folder).select("path").where(is_image(F.col("path")))
    return df.select("path", basename(F.col("path")).alias("filename"), (F.element_at(F.split("path", "/"), -2) if nested else F.lit(None).cast("string")).alias("group_id"))


def features(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """A feature table (filename, features); with ``dim`` every row's length is asserted."""
    df = spark.read.parquet(path)
    if dim is not None:
        ok: Column = F.size("features") == dim
        df = df.withColumn("features", F.when(ok, F.col("features")).otherwise(F.raise_error(F.concat(F.lit(f"not of length {dim}: "), "filename"))))
    return df


def upload(names: DataFrame) -> DataFrame:
    """``names(name)`` -> (session_id, filename): blank names go, paths are made harmless; one short id for all."""
    session = names.sparkSession.sql("SELECT substr(uuid(), 1, 8) AS s").first().s
    return names.where(F.trim("name") != "").select(F.lit(session).alias("session_id"), safe_name(F.col("name")).alias("filename"))


def store(files: DataFrame, folder: str) -> DataFrame:
    """``files(name, content)`` -> stored as a table under ``folder/<session>``: (session_id, filename, content).

    Blank names go and paths are made harmless; of one name the largest content stays.
    """
    session = files.sparkSession.sql("SELECT substr(uuid(), 1, 8) AS s").first().s
    kept = files.where(F.trim("name") != "").select(safe_name(F.col("name")).alias("filename"), F.col("content").cast("binary").alias("content"))
    kept.groupBy("filename").agg(F.max("content").alias("content")).write.parquet(f"{folder}/{session}")
    return session_files(files.sparkSession, folder, session)


def session_files(spark: SparkSession, folder: str, session: str) -> DataFrame:
    """(session_id, filename, content) of a session; ``UnknownSession`` if there is none, ``ValueError`` if it is empty."""
    try:
        found = spark.read.parquet(f"{folder}/{session}")
    except AnalysisException as e:
        raise UnknownSession(session) from e
    if found.isEmpty():
        raise ValueError(f"session {session} has no files")
    return found.select(F.lit(session).alias("session_id"), "filename", "content")


def serve(table: DataFrame, name: str) -> DataFrame:
    """The rows whose path or base name is ``name``; none for a name that climbs."""
    return table.where((F.lit(name).contains("..") == F.lit(False)) & ((F.col("path") == name) | (basename(F.col("path")) == basename(F.lit(name)))))
