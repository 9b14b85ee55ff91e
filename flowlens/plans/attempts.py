"""Queries over events as packets and flows: emission order, and audits of attempted rows by what was captured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import emission, halo
from flowlens.operators import payloads as P
from flowlens.plans.catalog import query
from flowlens.plans.flows import read

_FLOWS = """
f AS (SELECT event_type AS file, user_id AS flow, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY event_type, user_id, date_trunc('hour', ts)),
d AS (SELECT *, least(first_ts + INTERVAL 1800 SECOND, last_ts + INTERVAL 120 SECOND) AS due FROM f),
e AS (SELECT d.file, flow, first_ts, n, count(ts) AS emitted FROM d LEFT JOIN events ON event_type = d.file AND ts < due GROUP BY ALL)
"""


def _flows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    packets = read(spark, d, "events").withColumnRenamed("event_type", "file")
    hours = packets.groupBy("file", F.col("user_id").alias("flow"), F.date_trunc("hour", "ts")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return hours.select("file", "flow", "first_ts", "last_ts", "n"), packets


@query(f"""
WITH {_FLOWS}
SELECT file, flow, epoch_us(first_ts) AS first_us, emitted, coalesce(sum(n) OVER w, 0)::BIGINT AS before FROM e
WINDOW w AS (PARTITION BY file ORDER BY emitted, first_ts, flow ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""")
def emission_order(spark: SparkSession, d: str) -> DataFrame:
    """Flows in the order in which they leave the meter, with the packets of the twenty that left before each."""
    flows, packets = _flows(spark, d)
    out = emission.emitted(flows, packets, "file", "first_ts", "last_ts", "ts")
    seen = halo.trailing_features(out, ["file"], ["emitted", "first_ts", "flow"], 20, {"before": F.col("n")}, {}, {})
    return seen.select("file", "flow", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), "emitted", "before")


_PACKETS = """
k AS (SELECT event_id, ts, 'h' || (user_id % 30) AS src, 's' || (event_id % 5) AS dst, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'POST /login HTTP/1.1 user=' || event_id WHEN 2 THEN 'GET /?q='' OR 1 union select ' || event_id
  WHEN 3 THEN '<script>alert(' || event_id || ')' WHEN 4 THEN NULL ELSE 'plain body ' || event_id END AS payload FROM events),
r AS (SELECT event_id AS row_id, CASE WHEN event_id % 40 = 0 THEN dst ELSE src END AS src, CASE WHEN event_id % 40 = 0 THEN src ELSE dst END AS dst, CASE WHEN event_id % 500 > 0 THEN ts + INTERVAL 1 SECOND END AS ts,
  (event_id % 60) * 300.0 AS duration, (event_id % 60)::DOUBLE AS bytes, ['Web Attack - SQL', 'Web Attack - XSS', 'Web Attack - Brute Force'][event_id % 3 + 1] AS label FROM k WHERE event_id % 20 = 0)
"""
# Fixed values of the library in SQL: the patterns of a family.
_SIGNED = r"""
h AS (SELECT *, CASE WHEN label LIKE '%SQL%' THEN regexp_matches(t, '(''|%27)\s*(or|and)\s+') OR regexp_matches(t, 'union\s+(all\s+)?select|union\+select') OR regexp_matches(t, '(--|%2d%2d|#|%23)') OR regexp_matches(t, 'information_schema|sleep\s*\(|benchmark\s*\(|select\s+')
  WHEN label LIKE '%XSS%' THEN regexp_matches(t, '<\s*script|%3cscript') OR regexp_matches(t, 'alert\s*\(|alert%28') ELSE regexp_matches(t, '\bpost\s+/.+http/') OR regexp_matches(t, 'login|signin|wp-login') OR regexp_matches(t, '(username|user|email|login|password|pass|pwd)=') END AS hit
  FROM (SELECT *, lower(coalesce(text, '')) AS t FROM x))
"""


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i, m = F.col("event_id"), F.col("event_id") % 7
    text = (
        F.when(m == 0, "").when(m == 1, F.concat(F.lit("POST /login HTTP/1.1 user="), i)).when(m == 2, F.concat(F.lit("GET /?q=' OR 1 union select "), i))
        .when(m == 3, F.concat(F.lit("<script>alert("), i, F.lit(")"))).when(m == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("plain body "), i))
    )
    packets = read(spark, d, "events").select(
        "event_id", "ts", F.concat(F.lit("h"), F.col("user_id") % 30).alias("src"), F.concat(F.lit("s"), i % 5).alias("dst"), F.encode(text, "ISO-8859-1").alias("payload")
    )
    back = i % 40 == 0
    labels = F.array(F.lit("Web Attack - SQL"), F.lit("Web Attack - XSS"), F.lit("Web Attack - Brute Force"))
    rows = packets.filter(i % 20 == 0).select(
        i.alias("row_id"), F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(i % 500 > 0, F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("row_ts"), (i % 60 * 300.0).alias("duration"), (i % 60).cast("double").alias("bytes"), labels[(i % 3).cast("int")].alias("label"),
    )
    return rows, packets


@query(f"""
WITH {_PACKETS}, w AS (SELECT * FROM r WHERE bytes > 0),
p AS (SELECT row_id, event_id, k.ts, payload, coalesce(octet_length(encode(payload)), 0) AS size FROM w JOIN k ON ((w.src = k.src AND w.dst = k.dst) OR (w.src = k.dst AND w.dst = k.src))
  AND (w.ts IS NULL OR k.ts BETWEEN w.ts - INTERVAL 3 SECOND AND w.ts + to_microseconds((duration * 1000000)::BIGINT) + INTERVAL 3 SECOND)),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY row_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
a AS (SELECT row_id, count(*) AS n_packets, coalesce(sum(size) FILTER (before < 200), 0)::BIGINT AS payload_bytes, string_agg(payload, chr(10) ORDER BY ts, event_id) FILTER (size > 0 AND before < 200) AS text FROM q GROUP BY 1),
x AS (SELECT r.*, coalesce(n_packets, 0) AS n_packets, coalesce(payload_bytes, 0) AS payload_bytes, text FROM r LEFT JOIN a USING (row_id)), {_SIGNED}
SELECT row_id, n_packets, payload_bytes, CASE WHEN bytes = 0 THEN 'not_scanned_zero_csv_forward_payload' WHEN n_packets > 0 THEN 'matched' ELSE 'not_matched' END AS status,
  CASE WHEN bytes = 0 THEN 'keep_excluded' WHEN n_packets = 0 THEN 'manual_review' WHEN hit THEN 'recover' WHEN trim(t) <> '' THEN 'manual_review' ELSE 'keep_excluded' END AS decision FROM h
""")
def attempted_packet_audit(spark: SparkSession, d: str) -> DataFrame:
    """Attempted rows and the packets of their window in both directions, payloads up to 200 bytes a row."""
    rows, packets = _rows(spark, d)
    out = P.attempted_packets(rows, packets, "row_id", ["src", "dst"], [("src", "dst")], "row_ts", "duration", "bytes", "label", "ts", "event_id", "payload", 3.0, 200)
    return out.select("row_id", "n_packets", "payload_bytes", F.col("pcap_match_status").alias("status"), F.col("signature_decision").alias("decision"))


@query(f"""
WITH {_PACKETS}, g AS (SELECT src, dst, date_trunc('hour', ts) AS hour, min(ts) AS fts, min(event_id) AS fid, count(payload) AS n_packets, coalesce(sum(octet_length(encode(payload))), 0)::BIGINT AS payload_bytes,
  coalesce(string_agg(payload, chr(10) ORDER BY event_id) FILTER (payload <> ''), '') AS text FROM k GROUP BY 1, 2, 3),
m AS (SELECT r.row_id, fid, CASE WHEN r.ts IS NOT NULL THEN abs(epoch_us(r.ts) - epoch_us(fts)) END AS delta_us, n_packets, payload_bytes, text FROM r JOIN g ON ((r.src = g.src AND r.dst = g.dst) OR (r.src = g.dst AND r.dst = g.src))
  WHERE r.ts IS NULL OR abs(epoch_us(r.ts) - epoch_us(fts)) <= 1200000000 QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY fid) = 1),
x AS (SELECT r.*, fid, delta_us, coalesce(n_packets, 0) AS n_packets, coalesce(payload_bytes, 0) AS payload_bytes, text FROM r LEFT JOIN m USING (row_id)), {_SIGNED}
SELECT row_id, fid AS matched_flow, delta_us, n_packets, payload_bytes, CASE WHEN fid IS NOT NULL THEN 'matched' ELSE 'not_matched' END AS status,
  CASE WHEN bytes = 0 THEN 'keep_excluded' WHEN fid IS NULL THEN 'manual_review' WHEN hit THEN 'recover' WHEN trim(t) <> '' THEN 'manual_review' ELSE 'keep_excluded' END AS decision FROM h
""")
def attempted_flow_audit(spark: SparkSession, d: str) -> DataFrame:
    """Attempted rows and the first flow within twenty minutes of them, with what its packets carry."""
    rows, packets = _rows(spark, d)
    item = F.struct("event_id", F.col("payload").alias("b"))
    flows = packets.groupBy("src", "dst", F.date_trunc("hour", "ts")).agg(F.min("ts").alias("fts"), F.min("event_id").alias("fid"), F.array_sort(F.collect_list(item)).alias("items"))
    flows = flows.select("src", "dst", "fts", "fid", F.col("items.b").alias("payloads"))
    out = P.attempted_flows(rows, flows, "row_id", ["src", "dst"], [("src", "dst")], "row_ts", "bytes", "label", "fts", "fid", "payloads", 1200.0)
    return out.select("row_id", "matched_flow", "delta_us", "n_packets", "payload_bytes", F.col("pcap_match_status").alias("status"), F.col("signature_decision").alias("decision"))
