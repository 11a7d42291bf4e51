"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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


def settle(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path`` if it was completely written before; else ``make()``, written there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
