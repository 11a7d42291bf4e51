"""Extension: first occurrences in a stream, with a watermark that bounds the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_occurrences(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key that the stream brings within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, key: str, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).count()


def run_once(spark: SparkSession, query: DataFrame, name: str, out: str, checkpoint: str) -> DataFrame:
    """Processes what there is, exactly once across restarts, into the Parquet table ``out``."""
    q = query.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    return spark.read.schema(query.schema).parquet(out)
