"""When flows leave the meter: the order in which trailing windows see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import micros
from flowlens.operators.ranks import ranked


def emitted(flows: DataFrame, packets: DataFrame, file: str, first: str, last: str, at: str, idle: float = 120.0, active: float = 1800.0) -> DataFrame:
    """flows with ``emitted``: how many packets of its file are read before the one that lets a flow go.

    A flow is due at min(first + active, last + idle) and goes with the first packet of its file at that time or later; all
    that are left go after the last packet. So flows leave in the order of emitted, those that leave together in the order
    in which they opened; (file, emitted, first, an id) orders them as they enter trailing windows.

    The count is a rank: due times and packets are ranked together within their file, and due times alone; what the ranks
    differ by are the packets before. Ranks come from ranges, so one file may hold any share of the packets. Flows of files
    without packets have 0; null times are never due and go last.
    """
    due = F.least(micros(first) + round(active * 1e6), micros(last) + round(idle * 1e6))
    marked = flows.withColumns({"_due": F.coalesce(due, F.lit(2**63 - 1)), "_flow": F.monotonically_increasing_id()})
    placed = ranked(marked, [file], ["_due", "_flow"], "_among")  # written out, so that ids stay as they are
    times = packets.select(F.col(file), micros(at).alias("_at"), F.lit(1).alias("_packet"), F.lit(None).cast("bigint").alias("_among")).filter("_at is not null")
    both = placed.select(file, F.col("_due").alias("_at"), F.lit(0).alias("_packet"), "_among").unionByName(times)
    before = ranked(both, [file], ["_at", "_packet", "_among"], "_all").filter("_packet = 0").select(F.col(file).alias("_file"), "_among", (F.col("_all") - F.col("_among")).alias("emitted"))
    same = F.col(file).eqNullSafe(F.col("_file")) & (placed["_among"] == before["_among"])
    return placed.join(before, same).select(*[placed[c] for c in flows.columns], "emitted")
