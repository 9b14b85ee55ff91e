"""Queries over events as packets: frames, captures written and read back, and stateful streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalars import micros
from flowlens.operators import flows as W
from flowlens.plans.catalog import query
from flowlens.plans.flows import port, read
from flowlens.scratch import new_path
from flowlens.sources import capture_source as D
from flowlens.sources import captures as C
from flowlens.streaming import stateful as S


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; a local session that names none gets one of its own."""
    return new_path(spark, "scratch")


def _bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as UDP datagrams from 10.x.x.x (the user) to 192.168.0.1, the event's id and type as their payload."""
    body = F.encode(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), "UTF-8")
    head = [
        F.unhex(F.lit("02" * 12 + "0800" + "4500")), _bytes(28 + F.length(body), 2), F.unhex(F.lit("0001" + "0000" + "4011" + "0000")),
        _bytes(F.lit(10 << 24) + F.col("user_id") % (1 << 24), 4), F.unhex(F.lit("C0A80001")),
        _bytes(1024 + F.col("event_id") % 50000, 2), _bytes(port() % 65536, 2), _bytes(8 + F.length(body), 2), F.unhex(F.lit("0000")),
    ]
    return read(spark, d, "events").select(
        F.lit("events").alias("file"), F.col("event_id").alias("seq"), micros("ts").alias("ts_us"), F.concat(*head, body).alias("frame")
    )


_PACKETS = """
SELECT event_id, epoch_us(ts) AS ts_us, '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS src_ip,
  '192.168.0.1' AS dst_ip, (1024 + event_id % 50000)::INTEGER AS src_port,
  (coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) % 65536)::INTEGER AS dst_port,
  event_id || ':' || event_type AS payload
FROM events
"""


def _projected(packets: DataFrame) -> DataFrame:
    text = F.decode("payload", "UTF-8")
    return C.flow_tuples(packets).select(
        F.split(text, ":")[0].cast("bigint").alias("event_id"), "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", text.alias("payload")
    )


@query(_PACKETS)
def frame_projection(spark: SparkSession, d: str) -> DataFrame:
    return _projected(frames(spark, d))


@query(_PACKETS)
def capture_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    C.write_slices(frames(spark, d), path)
    return _projected(C.read_captures(spark, path))


@query(_PACKETS)
def capture_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Written as classic captures by the data source and read back in byte ranges."""
    path = scratch(spark)
    D.write_captures(frames(spark, d), path)
    return _projected(D.read_ranges(spark, path, 256 << 10))


@query("""
WITH RECURSIVE p AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, t, t AS first, 1 AS flow FROM p WHERE rn = 1
  UNION ALL
  SELECT p.user_id, p.rn, p.t, CASE WHEN p.t >= least(f.first + 1800000000, f.t + 120000000) THEN p.t ELSE f.first END, CASE WHEN p.t >= least(f.first + 1800000000, f.t + 120000000) THEN f.flow + 1 ELSE f.flow END
  FROM f JOIN p ON p.user_id = f.user_id AND p.rn = f.rn + 1)
SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n_events FROM f GROUP BY user_id, flow
""")
def stream_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows of users from a stream over events, the open ones flushed at its end."""
    path, schema = scratch(spark), read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a glob, as a stream's own path must be a folder
    ended, last = S.with_end(stream, "ts", f"{path}/end")
    flows = S.drained(S.flows(ended, ["user_id"], "ts", 120, 1800), path, last, f"{path}/end")
    return flows.select("user_id", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "n_events")


@query("""
SELECT event_id AS id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w, 0)::DOUBLE AS error_sum, count(DISTINCT CASE WHEN k <> 0 THEN k END) OVER w AS port_distinct
FROM (SELECT *, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 375 PRECEDING AND 1 PRECEDING)
""")
def stream_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Errors and distinct ports among the 375 events before each event of a user, from a stream over events."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a glob, as a stream's own path must be a folder
    flagged = stream.withColumns({"error": (F.col("event_type") == "error").cast("int"), "port": port()})
    return S.drained(S.trailing_features(flagged, ["user_id"], "event_id", "ts", 375, ["error"], ["port"]), scratch(spark))


@query("""
WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t, user_id % 9 AS x, user_id % 7 AS y, 40 + event_id % 100 AS size, event_id % 32 AS flags FROM events),
k AS (SELECT *, least(x * 10, y * 10 + 1) AS a, greatest(x * 10, y * 10 + 1) AS b, row_number() OVER (PARTITION BY x, y ORDER BY t, event_id) AS rn FROM e),
r AS (SELECT x, y, rn, t, t AS first, 1 AS flow FROM k WHERE rn = 1
  UNION ALL SELECT k.x, k.y, k.rn, k.t, CASE WHEN k.t >= least(r.first + 36000000000, r.t + 7200000000) THEN k.t ELSE r.first END, CASE WHEN k.t >= least(r.first + 36000000000, r.t + 7200000000) THEN r.flow + 1 ELSE r.flow END
  FROM r JOIN k ON k.x = r.x AND k.y = r.y AND k.rn = r.rn + 1),
p AS (SELECT k.*, r.flow, (t - lag(t) OVER w) / 1000.0 AS gap, event_id % 3 = 0 AS turned, first_value(event_id % 3 = 0) OVER w AS first_turned FROM k JOIN r USING (x, y, rn, t) WINDOW w AS (PARTITION BY x, y, flow ORDER BY t, event_id)),
q AS (SELECT *, turned = first_turned AS fwd, sum(CASE WHEN gap > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY x, y, flow ORDER BY t, event_id) AS period FROM p),
g AS (SELECT x, y, flow, period, (max(t) - min(t)) / 1000.0 AS active FROM q GROUP BY ALL),
h AS (SELECT x, y, flow, avg(active) AS active_mean, stddev_pop(active) AS active_std, count(*) AS periods FROM g GROUP BY ALL)
SELECT q.x, q.y, flow AS flow_number, min(t) AS first_us, max(t) AS last_us, count(*)::DOUBLE AS packets, count(*) FILTER (fwd)::DOUBLE AS fwd_packets, sum(size)::DOUBLE AS bytes, coalesce(sum(size) FILTER (NOT fwd), 0)::DOUBLE AS bwd_bytes,
  min(size)::DOUBLE AS min_ps, round(coalesce(stddev_samp(size), 0), 5) AS std_ps, round(coalesce(avg(gap), 0), 5) AS mean_piat, coalesce(max(gap), 0)::DOUBLE AS max_piat, count(*) FILTER (flags & 2 > 0)::DOUBLE AS syn, count(*) FILTER (fwd AND flags & 16 > 0)::DOUBLE AS fwd_ack,
  round(any_value(active_mean), 4) AS active_mean, round(any_value(active_std), 4) AS active_std, coalesce(max(gap) FILTER (gap > 3600000), 0)::DOUBLE AS idle_max
FROM q JOIN h USING (x, y, flow) GROUP BY q.x, q.y, flow
""")
def packet_flows(spark: SparkSession, d: str) -> DataFrame:
    """Events as packets between two endpoints, a third of them the other way: flows by timeouts, with sizes, gaps and flags."""
    e, i, u = read(spark, d, "events"), F.col("event_id"), F.col("user_id")
    one = F.struct(F.concat(F.lit("10.0.0."), (u % 9).cast("string")).alias("ip"), (u % 9).cast("int").alias("port"))
    two = F.struct(F.concat(F.lit("10.0.1."), (u % 7).cast("string")).alias("ip"), (u % 7).cast("int").alias("port"))
    src, dst = F.when(i % 3 == 0, two).otherwise(one), F.when(i % 3 == 0, one).otherwise(two)
    p = e.select(
        (u % 9).alias("x"), (u % 7).alias("y"), src["ip"].alias("src_ip"), src["port"].alias("src_port"), dst["ip"].alias("dst_ip"), dst["port"].alias("dst_port"), F.lit(6).alias("protocol"),
        micros("ts").alias("ts_us"), i.alias("seq"), (40 + i % 100).alias("ip_size"), (i % 32).cast("int").alias("tcp_flags"),
    )
    f = W.flow_records(p, 7200.0, 36000.0, 3600.0, ["x", "y"])
    b = "bidirectional"
    return f.select(
        "x", "y", "flow_number", F.col("first_seen_us").alias("first_us"), F.col("last_seen_us").alias("last_us"), F.col(f"{b}_packets").alias("packets"), F.col("src2dst_packets").alias("fwd_packets"),
        F.col(f"{b}_bytes").alias("bytes"), F.col("dst2src_bytes").alias("bwd_bytes"), F.col(f"{b}_min_ps").alias("min_ps"), F.round(f"{b}_stddev_ps", 5).alias("std_ps"), F.round(f"{b}_mean_piat_ms", 5).alias("mean_piat"),
        F.col(f"{b}_max_piat_ms").alias("max_piat"), F.col(f"{b}_syn_packets").alias("syn"), F.col("src2dst_ack_packets").alias("fwd_ack"), F.round(f"{b}_mean_active_ms", 4).alias("active_mean"),
        F.round(f"{b}_std_active_ms", 4).alias("active_std"), F.col(f"{b}_max_idle_ms").alias("idle_max"),
    )


@query("""
SELECT '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS src_ip, (1024 + event_id % 50000)::DOUBLE AS src_port, 1::DOUBLE AS packets,
  (28 + strlen(event_id || ':' || event_type))::DOUBLE AS bytes FROM events
""")
def capture_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows read from captures: every event is a datagram from a port of its own, so a flow of one packet."""
    path = scratch(spark)
    C.write_slices(frames(spark, d), path)
    return W.read_flows(spark, path).select("src_ip", "src_port", F.col("bidirectional_packets").alias("packets"), F.col("bidirectional_bytes").alias("bytes"))
