"""A local session for tests and benchmarks; on a cluster the session is given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName("twinsieve")
    base = {
        "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
