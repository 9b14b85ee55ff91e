"""Session settings that every operator of the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "flowlens", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow.

    cores asks for a local session of so many cores, with few shuffle partitions. Without it master, memory and shuffle
    partitions are the submitter's (spark-submit, spark-defaults), as on a cluster.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        base |= {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
