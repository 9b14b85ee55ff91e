"""Queries over events, orders and lineitem as flows, candidates and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.vocabulary import HTTP_PORTS, VULNERABLE_PORTS
from flowlens.operators import halo as H
from flowlens.operators import joins as J
from flowlens.operators import ordered as O
from flowlens.plans.catalog import query


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def port() -> F.Column:
    return F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))


_TRAILING = """
SELECT event_id,
  coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS click_sum,
  coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS error_sum,
  coalesce(sum(CASE WHEN k IN {http} THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS http_sum,
  coalesce(sum(CASE WHEN k IN {vulnerable} THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS vulnerable_sum,
  round(coalesce(avg(value) OVER w, 0.0), 9) AS mean_value,
  count(DISTINCT CASE WHEN k <> 0 THEN k END) OVER w AS distinct_ports
FROM (SELECT *, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)
"""


def _trailing(spark, d, rows):
    e = read(spark, d, "events").withColumn("k", port())
    kind = F.col("event_type")
    out = H.trailing_features(
        e, ["user_id"], ["ts", "event_id"], rows,
        {"click_sum": (kind == "click").cast("int"), "error_sum": (kind == "error").cast("int"), "http_sum": F.col("k").isin(*HTTP_PORTS).cast("int"), "vulnerable_sum": F.col("k").isin(*VULNERABLE_PORTS).cast("int")},
        {"mean_value": F.col("value")},
        {"distinct_ports": F.when(F.col("k") != 0, F.col("k"))},
    )
    return out.select("event_id", "click_sum", "error_sum", "http_sum", "vulnerable_sum", F.round("mean_value", 9).alias("mean_value"), "distinct_ports")


@query(_TRAILING.format(rows=375, http=HTTP_PORTS, vulnerable=VULNERABLE_PORTS))
def trailing_window_features(spark: SparkSession, d: str) -> DataFrame:
    return _trailing(spark, d, 375)


@query(_TRAILING.format(rows=5, http=HTTP_PORTS, vulnerable=VULNERABLE_PORTS))
def trailing_window_small(spark: SparkSession, d: str) -> DataFrame:
    return _trailing(spark, d, 5)


@query(f"""
SELECT event_id, k AS dst_port, (k IN {HTTP_PORTS}) AS is_http, (k = 53) AS is_dns, (k IN {VULNERABLE_PORTS}) AS is_vulnerable,
  coalesce(value, 0.0) * 1000.0 AS duration_us
FROM (SELECT *, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
""")
def snapshot_projection(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("dst_port", port())
    p = F.col("dst_port")
    return e.select("event_id", "dst_port", p.isin(*HTTP_PORTS).alias("is_http"), (p == 53).alias("is_dns"), p.isin(*VULNERABLE_PORTS).alias("is_vulnerable"), (S.number(F.col("value")) * 1000.0).alias("duration_us"))


@query("""
WITH o AS (SELECT o_custkey, o_orderdate AS start, o_orderdate + INTERVAL 30 DAY AS finish FROM orders),
m AS (SELECT *, CASE WHEN start > max(finish) OVER (PARTITION BY o_custkey ORDER BY start, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
                    WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY start, finish) = 1 THEN 1 ELSE 0 END AS opens FROM o),
i AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey ORDER BY start, finish ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, min(start) AS start, max(finish) AS finish, count(*) AS merged FROM i GROUP BY o_custkey, island
""")
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("start"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("finish"))
    return O.merged_intervals(o, ["o_custkey"], "start", "finish")


_ISLANDS = """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {us} THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)
"""


@query(_ISLANDS.format(us=120_000_000) + "SELECT user_id, island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY user_id, island")
def session_flows_idle(spark: SparkSession, d: str) -> DataFrame:
    e = O.gap_islands(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", 120.0)
    return e.groupBy("user_id", F.col("island").cast("bigint").alias("island")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, t, t AS first, 1 AS flow FROM p WHERE rn = 1
  UNION ALL
  SELECT p.user_id, p.rn, p.t, CASE WHEN p.t >= least(f.first + 36000, f.t + 7200) THEN p.t ELSE f.first END, CASE WHEN p.t >= least(f.first + 36000, f.t + 7200) THEN f.flow + 1 ELSE f.flow END
  FROM f JOIN p ON p.user_id = f.user_id AND p.rn = f.rn + 1)
SELECT user_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n_events FROM f GROUP BY user_id, flow
""")
def session_flows_idle_active(spark: SparkSession, d: str) -> DataFrame:
    return O.timeout_flows(read(spark, d, "events"), ["user_id"], "ts", 7200.0, 36000.0)


@query(_ISLANDS.format(us=3_600_000_000).replace(">=", ">") + """
, a AS (SELECT user_id, island, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS active, min(ts) AS s, max(ts) AS e FROM i GROUP BY ALL),
b AS (SELECT *, (epoch_us(s) - epoch_us(lag(e) OVER (PARTITION BY user_id ORDER BY s))) / 1000.0 AS idle FROM a)
SELECT user_id, round(avg(active), 4) AS mean_active, round(stddev_pop(active), 4) AS std_active, max(active) AS max_active, min(active) AS min_active,
  round(coalesce(avg(idle), 0), 4) AS mean_idle, round(coalesce(stddev_pop(idle), 0), 4) AS std_idle, coalesce(max(idle), 0) AS max_idle, coalesce(min(idle), 0) AS min_idle
FROM b GROUP BY user_id
""")
def active_idle_stats(spark: SparkSession, d: str) -> DataFrame:
    e = O.gap_islands(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", 3600.0, beyond=True)
    us = e.groupBy("user_id", "island").agg(S.micros(F.min("ts")).alias("s"), S.micros(F.max("ts")).alias("e"))
    w = Window.partitionBy("user_id").orderBy("s")
    p = us.select("user_id", (F.col("e") - F.col("s")).alias("active_us"), (F.col("s") - F.lag("e").over(w)).alias("idle_us"))
    p = p.withColumns({"active": F.col("active_us") / 1000.0, "idle": F.col("idle_us") / 1000.0})
    zero = F.lit(0.0)

    def mean(us):  # of whole microseconds, so that the order of rows doesn't show in the last digit
        return F.round(F.coalesce(F.try_divide(F.sum(us), F.count(us)) / 1000.0, zero) * 10_000) / 10_000

    return p.groupBy("user_id").agg(
        mean("active_us").alias("mean_active"), F.round(F.stddev_pop("active"), 4).alias("std_active"), F.max("active").alias("max_active"), F.min("active").alias("min_active"),
        mean("idle_us").alias("mean_idle"), F.round(F.coalesce(F.stddev_pop("idle"), zero), 4).alias("std_idle"), F.coalesce(F.max("idle"), zero).alias("max_idle"), F.coalesce(F.min("idle"), zero).alias("min_idle"),
    )


@query("""
SELECT l_orderkey, count(*) AS packets, sum(l_quantity) AS bytes,
  min(l_quantity) AS min_ps, round(avg(l_quantity), 6) AS mean_ps, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std_ps, max(l_quantity) AS max_ps,
  count(*) FILTER (l_returnflag = 'A') AS fwd_packets, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS fwd_bytes,
  round(coalesce(avg(l_quantity) FILTER (l_returnflag = 'A'), 0), 6) AS fwd_mean_ps,
  count(*) FILTER (l_returnflag <> 'A') AS bwd_packets, coalesce(sum(l_quantity) FILTER (l_returnflag <> 'A'), 0) AS bwd_bytes,
  (epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 1000.0 AS duration_ms
FROM lineitem GROUP BY l_orderkey
""")
def flow_packet_stats(spark: SparkSession, d: str) -> DataFrame:
    q, fwd = F.col("l_quantity"), F.col("l_returnflag") == "A"
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(q).alias("bytes"), F.min(q).alias("min_ps"), F.round(F.avg(q), 6).alias("mean_ps"),
        F.round(F.coalesce(F.stddev_samp(q), F.lit(0.0)), 6).alias("std_ps"), F.max(q).alias("max_ps"),
        F.count_if(fwd).alias("fwd_packets"), F.coalesce(F.sum(F.when(fwd, q)), F.lit(0.0)).alias("fwd_bytes"), F.round(F.coalesce(F.avg(F.when(fwd, q)), F.lit(0.0)), 6).alias("fwd_mean_ps"),
        F.count_if(~fwd).alias("bwd_packets"), F.coalesce(F.sum(F.when(~fwd, q)), F.lit(0.0)).alias("bwd_bytes"),
        ((S.micros(F.max("l_shipdate")) - S.micros(F.min("l_shipdate"))) / 1000.0).alias("duration_ms"),
    )


@query("""
SELECT o_custkey, o_orderkey, greatest(n - o_totalprice, 0) AS delta FROM
 (SELECT *, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS NOT NULL
""")
def link_deltas(spark: SparkSession, d: str) -> DataFrame:
    return O.link_deltas(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "delta")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3")
def first_n_packets(spark: SparkSession, d: str) -> DataFrame:
    return O.first_per_key(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("""
WITH s AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS segment FROM events)
SELECT user_id, segment, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL
""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return O.segments(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], 20).groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""
WITH s AS (SELECT o_custkey, o_orderdate AS moment, 1 AS step FROM orders UNION ALL SELECT o_custkey, o_orderdate + INTERVAL 60 DAY, -1 FROM orders),
t AS (SELECT o_custkey, moment, sum(step) AS step FROM s GROUP BY ALL),
r AS (SELECT o_custkey, sum(step) OVER (PARTITION BY o_custkey ORDER BY moment ROWS UNBOUNDED PRECEDING) AS open FROM t)
SELECT o_custkey, max(open)::BIGINT AS peak FROM r GROUP BY o_custkey
""")
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("finish", F.expr("o_orderdate + INTERVAL 60 DAY"))
    return O.peak_concurrency(o, ["o_custkey"], "o_orderdate", "finish")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS round, count(*) OVER (PARTITION BY event_type) AS size FROM events)
SELECT event_id, event_type, round FROM r ORDER BY round, size DESC, event_type LIMIT 200
""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return O.round_robin(read(spark, d, "events"), "event_type", ["ts", "event_id"], 200).select("event_id", "event_type", F.col("round").cast("bigint").alias("round"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS size FROM events)
SELECT event_id, event_type, place FROM r WHERE size <= 50 OR place IN (SELECT round_even(i * (r.size - 1) / 49.0, 0)::BIGINT FROM range(50) t(i))
""")
def even_take(spark: SparkSession, d: str) -> DataFrame:
    return O.even_take(read(spark, d, "events"), ["event_type"], ["ts", "event_id"], 50).select("event_id", "event_type", F.col("place").cast("bigint").alias("place"))


@query("""
WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, user_id LIMIT 10)
SELECT e.event_id, e.user_id, t.n AS density FROM events e JOIN t USING (user_id)
""")
def density_order(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    top = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("density")).orderBy(F.desc("density"), "user_id").limit(10)
    return e.join(F.broadcast(top), "user_id").select("event_id", "user_id", "density")


_WINDOWS = [(0, "1-URGENT", "1995-01-01", "1996-06-30", "DoS"), (1, "1-URGENT", "1996-01-01", "1997-12-31", "DDoS"), (2, "3-MEDIUM", "1994-01-01", "1999-12-31", "Bot"), (3, "5-LOW", "1998-01-01", "1998-12-31", "Benign")]
_WINDOWS_SQL = ", ".join(f"({n}, '{p}', TIMESTAMP '{a}', TIMESTAMP '{b}', '{c}')" for n, p, a, b, c in _WINDOWS)
_MATCHED = f"""
WITH w(n, p, a, b, klass) AS (VALUES {_WINDOWS_SQL}),
m AS (SELECT o.*, w.n AS ordinal, w.klass FROM orders o LEFT JOIN w ON o.o_orderpriority = w.p AND o.o_orderdate BETWEEN w.a AND w.b
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY w.n NULLS LAST) = 1)
"""


def _matched(spark, d):
    at, p = F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority")
    spans = [((n, klass), (p == name) & at.between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))) for n, name, a, b, klass in _WINDOWS]
    return read(spark, d, "orders").withColumn("w", J.first_window(spans, "ordinal int, klass string")).select("*", "w.*")


@query(_MATCHED + "SELECT o_orderkey, ordinal, klass FROM m")
def attack_window_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("o_orderkey", "ordinal", "klass")


@query(_MATCHED + """
, c AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'Benign' WHEN 'F' THEN 'DoS' END AS k, CASE WHEN o_totalprice < 50000 THEN 'excluded' ELSE 'accepted_label' END AS s, klass FROM m)
SELECT CASE WHEN k IS NULL THEN 'unknown_csv_label' WHEN s <> 'accepted_label' AND klass IS NOT NULL THEN 'excluded_csv_label_with_gt_match'
  WHEN s <> 'accepted_label' THEN 'excluded_csv_label_without_gt_match' WHEN klass IS NULL AND k = 'Benign' THEN 'agreement_benign' WHEN klass IS NULL THEN 'csv_attack_no_gt_match'
  WHEN k = 'Benign' THEN 'csv_benign_gt_attack_match' WHEN k = klass THEN 'agreement_attack' ELSE 'csv_gt_class_mismatch' END AS status, count(*) AS n FROM c GROUP BY 1
""")
def crosscheck_status_counts(spark: SparkSession, d: str) -> DataFrame:
    from flowlens.operators.labels import crosscheck

    k = F.when(F.col("o_orderstatus") == "O", "Benign").when(F.col("o_orderstatus") == "F", "DoS")
    s = F.when(F.col("o_totalprice") < 50000, "excluded").otherwise("accepted_label")
    return _matched(spark, d).groupBy(crosscheck(k, s, F.col("klass")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT a.event_id AS id, b.event_id AS other, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS delta FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 10800000000),
r AS (SELECT *, row_number() OVER w AS n, lead(delta) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY delta, other))
SELECT e.event_id AS id, r.other, r.delta AS delta_us, CASE WHEN r.id IS NULL THEN 'TEMPORAL_CONTEXT_MISSING' WHEN r.nxt = r.delta THEN 'AMBIGUOUS_TEMPORAL_CONTEXT' ELSE 'full' END AS status
FROM events e LEFT JOIN r ON r.id = e.event_id AND r.n = 1 WHERE e.event_type = 'click'
""")
def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    a = e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", "ts")
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("other_ts"))
    return J.nearest(a, b, ["user_id"], "id", "ts", "other_ts", "other", 10800.0).select("id", "other", "delta_us", "status")


@query("""
WITH c AS (SELECT event_id AS cid, user_id % 7 AS x, user_id % 5 AS y, ts AS cts FROM events WHERE event_type = 'signup'),
f AS (SELECT event_id AS fid, user_id % 7 AS x, user_id % 5 AS y, ts AS fts FROM events WHERE event_type = 'view'),
t AS (SELECT *, false AS reversed FROM c UNION ALL SELECT cid, y, x, cts, true FROM c),
p AS (SELECT t.cid, f.fid, min(reversed) AS reversed, min(abs(epoch_us(cts) - epoch_us(fts))) AS delta_us FROM t JOIN f USING (x, y) WHERE abs(epoch_us(cts) - epoch_us(fts)) <= 3600000000 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS n, lead({'r': reversed, 'd': delta_us}) OVER w AS nxt, count(*) OVER (PARTITION BY cid) AS n_matches FROM p WINDOW w AS (PARTITION BY cid ORDER BY reversed, delta_us, fid))
SELECT cid, fid, reversed, delta_us, n_matches, CASE WHEN nxt = {'r': reversed, 'd': delta_us} THEN 'AMBIGUOUS_MATCH' ELSE 'MATCHED' END AS status FROM r WHERE n = 1
""")
def tolerance_match_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("x"), (F.col("user_id") % 5).alias("y"), "ts")
    c = e.filter("event_type = 'signup'").select(F.col("event_id").alias("cid"), "x", "y", F.col("ts").alias("cts"))
    f = e.filter("event_type = 'view'").select(F.col("event_id").alias("fid"), "x", "y", F.col("ts").alias("fts"))
    out = J.match_flows(c, f, ["x", "y"], [("x", "y")], "cid", "cts", "fts", "fid", 3600.0)
    return out.select("cid", "fid", "reversed", "delta_us", "n_matches", "status")


@query("SELECT event_id FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000)")
def tolerance_semi(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    b = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("b_ts"))
    return J.within(e.filter("event_type = 'view'"), b, ["user_id"], "ts", "b_ts", 3600.0, "inner").select("event_id").distinct()


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1997-01-01')")
def done_anti(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "orders").filter("o_orderdate >= TIMESTAMP '1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("""
WITH h AS (SELECT l_suppkey, avg((l_linestatus = 'F')::INT) AS share, count(*) AS n FROM lineitem GROUP BY 1)
SELECT s_suppkey, CASE WHEN share < 0.49 AND s_acctbal < 0 THEN 'low_yield|bad_status' WHEN share < 0.49 THEN 'low_yield' ELSE 'bad_status' END AS reasons
FROM supplier JOIN h ON l_suppkey = s_suppkey WHERE share < 0.49 OR s_acctbal < 0
""")
def health_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("share"))
    reasons = F.array_compact(F.array(F.when(F.col("share") < 0.49, "low_yield"), F.when(F.col("s_acctbal") < 0, "bad_status")))
    return read(spark, d, "supplier").join(h, "s_suppkey").withColumn("r", reasons).filter(F.size("r") > 0).select("s_suppkey", F.array_join("r", "|").alias("reasons"))


@query("""
WITH p AS (SELECT o_orderkey, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS delta FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, arg_min(delta, {'a': abs(delta), 'd': delta}) AS best_delta, bool_or(abs(delta) <= 2592000000000) AS within_month,
 CASE WHEN bool_or(abs(delta) <= 2592000000000) THEN 'near' WHEN bool_or(abs(delta) <= 31536000000000) THEN 'same_year' ELSE 'far' END AS kind FROM p GROUP BY 1
""")
def argmin_delta_classify(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    p = read(spark, d, "orders").join(line, "o_orderkey").withColumn("delta", S.micros("l_shipdate") - S.micros("o_orderdate"))
    size = F.abs("delta")
    month, year = F.bool_or(size <= 2592000000000), F.bool_or(size <= 31536000000000)
    return p.groupBy("o_orderkey").agg(F.min_by("delta", F.struct(size, "delta")).alias("best_delta"), month.alias("within_month"), F.when(month, "near").when(year, "same_year").otherwise("far").alias("kind"))
