"""From packets to flows: which flow a packet belongs to, and what a flow is like in each direction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowlens.functions import vocabulary as V
from flowlens.functions.scalars import number, safe_divide
from flowlens.operators.ordered import key_changes
from flowlens.sources import captures

TUPLE = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
# Bits of the TCP flags.
FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}


def numbered(packets: DataFrame, keys: list[str], ts_us: str, order: list[str], idle: float, active: float, name: str = "flow") -> DataFrame:
    """packets with the number of their flow within its keys, from 1; a flow ends at min(first + active, last + idle) seconds.

    A packet at that very time opens the next flow. Rows are dealt by key and sorted (Spark spills the sort), then pass as
    a stream: a task holds the open flow's key, first and last time and number only.
    """
    idle_us, active_us = round(idle * 1e6), round(active * 1e6)
    dealt = packets.filter(F.col(ts_us).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, ts_us, *order)
    schema = StructType([*dealt.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key as a batch of one row, first, last, number
        for batch in batches:
            if not batch.num_rows:
                continue
            key, us, numbers = batch.select(keys), batch.column(ts_us).to_numpy(), np.empty(batch.num_rows, np.int64)
            turns = [0, *(np.flatnonzero(key_changes(key)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(turns, turns[1:], strict=False):
                times, one = us[start:stop], key.slice(start, 1)
                gaps = [*(np.flatnonzero(np.diff(times) >= idle_us) + 1).tolist(), len(times)]
                if held is not None and (start or key_changes(pa.Table.from_batches([held[0], one]).combine_chunks().to_batches()[0]).any()):
                    held = None
                first, last, n = (None, None, 0) if held is None else held[1:]
                at = gap = 0
                while at < len(times):
                    while gaps[gap] <= at:
                        gap += 1
                    if first is None or times[at] >= min(first + active_us, last + idle_us):
                        first, n = int(times[at]), n + 1
                    end = max(at + 1, min(gaps[gap], int(np.searchsorted(times, first + active_us))))
                    numbers[start + at : start + end] = n
                    last, at = int(times[end - 1]), end
                held = (one, first, last, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, name])

    return dealt.mapInArrow(run, schema)


def both_ways(packets: DataFrame) -> DataFrame:
    """packets(src_ip, src_port, dst_ip, dst_port, ...) with TUPLE, which both directions share, and from_a."""
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return packets.withColumns({"ip_a": low["ip"], "port_a": low["port"], "ip_b": high["ip"], "port_b": high["port"], "from_a": a == low})


def flow_records(packets: DataFrame, idle: float = 120.0, active: float = 1800.0, pause: float = 1.0, scope: list[str] | None = None) -> DataFrame:
    """One row per flow: its endpoints (source is that of the first packet), first_seen_us, last_seen_us and its 76 features.

    packets has src_ip, src_port, dst_ip, dst_port, protocol, ts_us, seq, ip_size and tcp_flags; scope columns (a file, a
    day) keep flows apart. Sizes and gaps have sample deviations, 0 for a single one. Active periods end after gaps longer
    than pause seconds; their and the idle gaps' deviations are those of the population, and without idle gaps all are 0.
    """
    keys = [*(scope or []), *TUPLE]
    p = numbered(both_ways(packets), keys, "ts_us", ["seq"], idle, active)
    flow = [*keys, "flow"]
    w, side = Window.partitionBy(*flow).orderBy("ts_us", "seq"), Window.partitionBy(*flow, "from_a").orderBy("ts_us", "seq")
    gap = (F.col("ts_us") - F.lag("ts_us").over(w)) / 1000.0
    p = p.withColumns({"gap": gap, "own_gap": (F.col("ts_us") - F.lag("ts_us").over(side)) / 1000.0})
    p = p.withColumn("period", F.sum(F.when(F.col("gap") > pause * 1000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Periods first, then flows: moments of sizes and gaps are carried as sums of both, so packets are aggregated once.
    ways = {"all": F.lit(True), "a": F.col("from_a"), "b": ~F.col("from_a")}

    def moments(name: str, value: Column, when: Column) -> list[Column]:
        v = F.when(when, value)
        return [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_s"), F.sum(v * v).alias(f"{name}_q"), F.min(v).alias(f"{name}_lo"), F.max(v).alias(f"{name}_hi")]

    size, facts = F.col("ip_size").cast("double"), []
    for way, when in ways.items():
        facts += moments(f"{way}_ps", size, when)
        facts += moments(f"{way}_piat", F.col("gap") if way == "all" else F.col("own_gap"), when)
        facts += [F.count_if(when & (F.col("tcp_flags").bitwiseAND(F.lit(bit)) > 0)).alias(f"{way}_{flag}") for flag, bit in FLAGS.items()]
        facts += [F.min(F.when(when, F.col("ts_us"))).alias(f"{way}_from"), F.max(F.when(when, F.col("ts_us"))).alias(f"{way}_to")]
    opening = F.min_by("from_a", F.struct("ts_us", "seq"))
    periods = p.groupBy(*flow, "period").agg(*facts, opening.alias("forward"), F.max(F.when(F.col("gap") > pause * 1000, F.col("gap"))).alias("idle"))
    how = {"n": F.sum, "s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max, "from": F.min, "to": F.max}
    total = [how.get(c.rsplit("_", 1)[1], F.sum)(c).alias(c) for c in periods.columns if c.startswith(("all_", "a_", "b_"))]
    length = (F.col("all_to") - F.col("all_from")) / 1000.0
    rest = [f(x).alias(f"{name}_{n}") for name, x in (("active", length), ("idle", F.col("idle"))) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))]
    f = periods.groupBy(*flow).agg(*total, F.min_by("forward", "period").alias("forward"), *rest)

    def chosen(way: str, what: str) -> Column:
        if way == "bidirectional":
            return F.col(f"all_{what}")
        return F.when(F.col("forward") == F.lit(way == "src2dst"), F.col(f"a_{what}")).otherwise(F.col(f"b_{what}"))

    def described(way: str, what: str) -> dict[str, Column]:
        n, s, q = (chosen(way, f"{what}_{x}") for x in ("n", "s", "q"))
        spread = F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
        return {"min": chosen(way, f"{what}_lo"), "mean": safe_divide(s, n), "stddev": F.when(n > 1, spread), "max": chosen(way, f"{what}_hi")}

    out: dict[str, Column] = {}
    for way in V.DIRECTIONS:
        out |= {f"{way}_{k}_ps": c for k, c in described(way, "ps").items()}
        out |= {f"{way}_{k}_piat_ms": c for k, c in described(way, "piat").items()}
        out |= {f"{way}_{flag}_packets": chosen(way, flag) for flag in FLAGS}
        out |= {f"{way}_packets": chosen(way, "ps_n"), f"{way}_bytes": chosen(way, "ps_s"), f"{way}_duration_ms": (chosen(way, "to") - chosen(way, "from")) / 1000.0}
        seconds = out[f"{way}_duration_ms"] / 1000.0
        out |= {f"{way}_bytes_per_second": safe_divide(out[f"{way}_bytes"], seconds), f"{way}_packets_per_second": safe_divide(out[f"{way}_packets"], seconds)}
    out |= {f"bidirectional_{n}_{k}_ms": F.col(f"{k}_{n}") for k in ("active", "idle") for n in ("mean", "std", "max", "min")}
    first = F.col("forward")
    ends = {"src_ip": ("ip_a", "ip_b"), "src_port": ("port_a", "port_b"), "dst_ip": ("ip_b", "ip_a"), "dst_port": ("port_b", "port_a")}
    named = {k: F.when(first, F.col(x)).otherwise(F.col(y)) for k, (x, y) in ends.items()}
    out |= {"src_port": named["src_port"], "dst_port": named["dst_port"], "protocol": F.col("protocol")}
    out |= {"down_up_bytes_ratio": safe_divide(out["dst2src_bytes"], out["src2dst_bytes"]), "average_packet_size": safe_divide(out["bidirectional_bytes"], out["bidirectional_packets"])}
    return f.select(
        *(scope or []), named["src_ip"].alias("src_ip"), named["dst_ip"].alias("dst_ip"), F.col("flow").alias("flow_number"), F.col("all_from").alias("first_seen_us"), F.col("all_to").alias("last_seen_us"),
        *[number(out[name]).alias(name) for name in V.flow_features()],
    )


def read_flows(spark: SparkSession, path: str, idle: float = 120.0, active: float = 1800.0) -> DataFrame:
    """The flows of the captures at path, file by file; see flow_records."""
    return flow_records(captures.flow_tuples(captures.read_captures(spark, path)), idle, active, scope=["file"])


def of_first_packets(packets: DataFrame, flow: list[str], wanted: DataFrame, on: list[str]) -> DataFrame:
    """The packets of flows whose first packet's tuple is wanted; later packets of a flow are not asked."""
    first = packets.groupBy(*flow).agg(F.min_by(F.struct(*on), F.struct("ts_us", "seq")).alias("_first"))
    kept = first.select(*flow, "_first.*") if not set(on) & set(flow) else first.select(*flow, *[F.col(f"_first.{c}").alias(c) for c in on if c not in flow])
    return packets.join(kept.join(wanted.select(*on).distinct(), on, "left_semi").select(*flow), flow, "left_semi")


def with_plugin(packets: DataFrame, flow: list[str], order: list[str], plugin: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row per flow of what a user's function makes of its packets in order; schema says what it returns.

    It is the place for state per flow that columns cannot express. A flow's packets are one group, so it is bounded by the
    flow's timeouts; cap packets per flow before where a capture can hold more.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.select(*flow).schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(flow, key, strict=True)) | plugin(rows.sort_values(order))])

    return packets.groupBy(*flow).applyInPandas(run, f"{fields}, {schema}")


def segment_facts(packets: DataFrame, flow: list[str], order: list[str], size: int) -> DataFrame:
    """(flow, segment_index, n_packets, reason, is_full_flow): flows cut after every ``size`` packets, and why each part ends."""
    w = Window.partitionBy(*flow).orderBy(*order)
    numbered_rows = packets.select(*flow, F.floor((F.row_number().over(w) - 1) / size).alias("segment_index"))
    parts = numbered_rows.groupBy(*flow, "segment_index").agg(F.count(F.lit(1)).alias("n_packets"))
    last = F.max("segment_index").over(Window.partitionBy(*flow))
    return parts.withColumns({"reason": F.when(F.col("segment_index") < last, "packet_limit").otherwise("flow_end"), "is_full_flow": last == 0})
