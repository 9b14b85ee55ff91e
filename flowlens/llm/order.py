"""The rows before and after each row in ascending order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import cut


def neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with structs before and after (of keys) of the rows next to each in ascending order of keys; the order closes to a ring.

    Each combination of keys stands once and none is null. The narrow table is split into ranges and written out with its
    range number, so that the ranges stay the same however often a task runs. Within a range the neighbours are the next
    rows; at its ends they are the ends of the ranges next to it, looked up in a table with one row per range.
    """
    ranged = cut(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys), "ranges")
    row = F.struct(*keys)
    ends = ranged.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    ring = Window.orderBy("part")  # one row per range
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outside = ends.select(
        "part",
        F.coalesce(F.lag("high").over(ring), F.last("high").over(every)).alias("end_before"),
        F.coalesce(F.lead("low").over(ring), F.first("low").over(every)).alias("end_after"),
    )
    within = Window.partitionBy("part").orderBy(*keys)
    return (
        ranged.withColumns({"before": F.lag(row).over(within), "after": F.lead(row).over(within)})
        .join(F.broadcast(outside), "part")
        .withColumns({"before": F.coalesce("before", "end_before"), "after": F.coalesce("after", "end_after")})
        .drop("part", "end_before", "end_after")
    )
