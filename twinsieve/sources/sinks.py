"""Results as tables, folders by group, JSON and an archive."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.storage import settle


def save_features(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def save_groups(groups: DataFrame, files: DataFrame, path: str) -> None:
    """``groups(group_id, filename)`` with their files' columns, one folder per group; files that are missing are left out."""
    groups.join(files, "filename").write.mode("overwrite").partitionBy("group_id").parquet(path)


def copy_groups(groups: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Copies ``files(filename, path)`` into a folder per group of ``groups(group_id, filename)`` under ``path``.

    Each file is copied by a task; missing ones are left out. What was in ``path`` goes
    first. (group_id, filename, copied)
    """
    jvm = groups.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(groups.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        # A plain path is one of this machine's own.
        at = lambda uri: fs.FileSystem.from_uri(uri if "://" in uri else "file://" + ("/" + uri.removeprefix("file:").lstrip("/")))
        target, base = at(path)
        for b in batches:
            done = []
            for group, name, source in zip(b["group_id"], b["filename"], b["path"], strict=True):
                files, where = at(source)
                found = files.get_file_info(where).type == fs.FileType.File
                if found:
                    target.create_dir(f"{base}/{group}", recursive=True)
                    with files.open_input_stream(where) as i, target.open_output_stream(f"{base}/{group}/{name}") as o:
                        while piece := i.read(1 << 20):
                            o.write(piece)
                done.append(found)
            yield pd.DataFrame({"group_id": b["group_id"].astype(str), "filename": b["filename"], "copied": done})

    return settle(groups.join(files, "filename").select("group_id", "filename", "path").mapInPandas(run, "group_id string, filename string, copied boolean"), "copied")


def result_json(groups: DataFrame, scores: DataFrame, points: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """One JSON text per group (its files, scores and points), and one of totals and times: (part, json)."""
    j = groups.join(scores, "filename", "left").join(points, "filename", "left")
    item = F.struct("filename", *[c for c in (*scores.columns, *points.columns) if c != "filename"])
    parts = j.groupBy("group_id").agg(F.to_json(F.struct(F.first("group_id").alias("group"), F.sort_array(F.collect_list(item)).alias("images"))).alias("json"))
    times = F.struct(*[F.lit(v).alias(k) for k, v in seconds.items()]) if seconds else F.lit(None).cast("struct<none:int>")
    head = groups.agg(F.count("*").alias("grouped"), F.countDistinct("group_id").alias("groups")).select(F.lit("summary").alias("part"), F.to_json(F.struct(F.col("grouped").alias("duplicate_count"), "groups", times.alias("performance"))).alias("json"))
    return parts.select(F.col("group_id").alias("part"), "json").unionByName(head)


def archive(files: Iterable[str], target: str) -> int:
    """Packs local files flat into a zip on this machine; the number packed. Missing ones are left out."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            if Path(f).is_file():
                z.write(f, Path(f).name)
                n += 1
    return n
