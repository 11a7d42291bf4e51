"""Shared storage, row keys and small text helpers used by the operators here."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; without that name there is none, and
    this raises. Only where all tasks run in this process (tests, a laptop) an own
    temporary folder does.
    """
    app = spark.sparkContext.applicationId
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/twinsieve-{app}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="twinsieve-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application settled; DataFrames that read them are of no use then."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``narrow``: a table of ids, far smaller than the texts that the number of shuffle
    partitions is made for; eight of these are one task, so there are fewer files.

    This cuts the lineage, survives the loss of any executor, and gives the
    optimizer the true size of the table, so joins with it are planned on facts.
    """
    path = fresh_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """The pyarrow file system of a URI, and the path in it, for tasks that write or read files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def crc_of_id(col: Column) -> Column:
    """crc32 of an id written as text; null stays null."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def single_threaded() -> None:
    """Native pools must not start more threads than the one core a task has."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ[name] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
