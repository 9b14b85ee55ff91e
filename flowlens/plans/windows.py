"""Queries over orders and events as labelled CSV rows, captures and flows around documented attack windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import vocabulary as V
from flowlens.functions.scalars import key_hash, undirected_hash
from flowlens.operators import attacks as A
from flowlens.operators import labels as L
from flowlens.operators import temporal as T
from flowlens.plans.catalog import query
from flowlens.plans.flows import read


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_DAYS = [*dict.fromkeys(w[0] for w in V.ATTACK_WINDOWS), "Saturday-03-03-2018"]
_IPS = ["172.31.69.25", "18.219.193.20", "172.31.69.28", "18.218.115.60", "172.31.69.13", "18.221.219.4", "13.58.98.64", "172.31.69.6", "18.219.211.138", "8.8.8.8"]
_LABELS = ["BENIGN", "FTP-BruteForce", "SSH-Bruteforce", "DoS attacks-Hulk", "DDOS attack-HOIC", "Web Attack - XSS", "Bot", "Infiltration", "DoS Hulk - Attempted", "odd"]
_STARTS = {w[0]: w[5] for w in reversed(V.ATTACK_WINDOWS)} | {"Saturday-03-03-2018": "2018-03-03 10:00:00"}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of labelled CSV files: all text, times around the day's first window."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(values, i):
        return F.array(*[F.lit(v) for v in values])[i.cast("int")]

    return read(spark, d, "orders").select(
        "o_orderkey", pick(_DAYS, k % 8).alias("day"), pick(_IPS, (k + c) % 10).alias("src"), pick(_IPS, (F.floor(k / 8) + c) % 10).alias("dst"),
        F.date_format(F.timestamp_seconds(F.unix_timestamp(pick([_STARTS[x] for x in _DAYS], k % 8).cast("timestamp")) + (c * 37) % 9000 - 600), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        pick(_LABELS, c % 10).alias("label"), F.when(k % 3 == 0, "21").otherwise("22").alias("port"), F.when(k % 5 == 0, "0").otherwise("12").alias("sent"),
    )


_ROWS = f"""
r AS (SELECT o_orderkey, {_list(_DAYS)}[(o_orderkey % 8 + 1)::INT] AS day, {_list(_IPS)}[((o_orderkey + o_custkey) % 10 + 1)::INT] AS src, {_list(_IPS)}[((o_orderkey // 8 + o_custkey) % 10 + 1)::INT] AS dst,
  {_list([_STARTS[x] for x in _DAYS])}[(o_orderkey % 8 + 1)::INT]::TIMESTAMP + to_seconds((o_custkey * 37) % 9000 - 600) AS ts, {_list(_LABELS)}[(o_custkey % 10 + 1)::INT] AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN '21' ELSE '22' END AS port, CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '12' END AS sent FROM orders),
w(n, wday, subtype, klass, att, vic, a, b) AS (VALUES {", ".join(f"({k}, '{w[0]}', '{w[1]}', '{w[2]}', {_list(w[3])}, {_list(w[4])}, TIMESTAMP '{w[5]}', TIMESTAMP '{w[6]}')" for k, w in enumerate(V.ATTACK_WINDOWS))}),
m AS (SELECT r.*, w.n, w.subtype, w.klass FROM r LEFT JOIN w ON r.day = w.wday AND r.ts BETWEEN w.a AND w.b AND CASE WHEN w.subtype = 'Infiltration' THEN list_contains(vic, src) OR list_contains(vic, dst)
  ELSE (list_contains(att, src) AND list_contains(vic, dst)) OR (list_contains(att, dst) AND list_contains(vic, src)) END QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY w.n NULLS LAST) = 1),
s AS (SELECT *, CASE label WHEN 'BENIGN' THEN 'Benign' WHEN 'FTP-BruteForce' THEN 'BruteForce' WHEN 'SSH-Bruteforce' THEN 'BruteForce' WHEN 'DoS attacks-Hulk' THEN 'DoS' WHEN 'DDOS attack-HOIC' THEN 'DDoS'
  WHEN 'Web Attack - XSS' THEN 'WebBased' WHEN 'Bot' THEN 'Bot' WHEN 'Infiltration' THEN 'Infiltration' WHEN 'DoS Hulk - Attempted' THEN 'DoS' END AS csv_class FROM m),
t AS (SELECT *, CASE WHEN csv_class IS NULL THEN 'unknown_label' WHEN label LIKE '%Attempted%' THEN 'excluded_attempted_or_non_success'
  WHEN day = 'Wednesday-14-02-2018' AND csv_class = 'BruteForce' AND dst = '172.31.69.25' AND src = '18.221.219.4' THEN 'excluded_documented_ftp_closed_port'
  WHEN day = 'Wednesday-14-02-2018' AND csv_class = 'BruteForce' AND dst = '172.31.69.25' AND src = '13.58.98.64' AND sent = '0' THEN 'excluded_documented_ssh_no_attacker_payload'
  WHEN day = 'Wednesday-14-02-2018' AND csv_class = 'BruteForce' AND dst = '172.31.69.25' AND src = '13.58.98.64' AND port = '21' THEN 'excluded_documented_ssh_wrong_service_port' ELSE 'accepted_label' END AS status FROM s)
"""


def _checked(spark, d):
    return A.crosschecked(_rows(spark, d), "day", "src", "dst", "ts", "label", "port", "sent")


@query(f"WITH {_ROWS} SELECT o_orderkey, n AS ordinal, subtype, klass FROM m")
def attack_windows_by_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("o_orderkey", "window.ordinal", "window.subtype", "window.klass")


@query(f"""WITH {_ROWS} SELECT day, status, CASE WHEN csv_class IS NULL THEN 'unknown_csv_label' WHEN status <> 'accepted_label' AND klass IS NOT NULL THEN 'excluded_csv_label_with_gt_match'
  WHEN status <> 'accepted_label' THEN 'excluded_csv_label_without_gt_match' WHEN klass IS NULL AND csv_class = 'Benign' THEN 'agreement_benign' WHEN klass IS NULL THEN 'csv_attack_no_gt_match'
  WHEN csv_class = 'Benign' THEN 'csv_benign_gt_attack_match' WHEN csv_class = klass THEN 'agreement_attack' ELSE 'csv_gt_class_mismatch' END AS agreement, count(*) AS n FROM t GROUP BY ALL""")
def labelled_rows_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    agreement = L.crosscheck(F.col("csv_class"), F.col("label_status"), F.col("window.klass"))
    return _checked(spark, d).groupBy("day", F.col("label_status").alias("status"), agreement.alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


_W17 = ", ".join(f"({k}, '{w[1]}', TIMESTAMP '{w[5]}', TIMESTAMP '{w[6]}')" for k, w in enumerate(V.WEB_WINDOWS_2017))


@query(f"""
WITH r AS (SELECT event_id, TIMESTAMP '2017-07-06 12:00:00' + to_seconds((event_id * 53) % 7200) AS ts, CASE WHEN event_id % 4 = 0 THEN '443' ELSE '80' END AS port, event_id % 3 = 0 AS reversed FROM events),
w(n, subtype, a, b) AS (VALUES {_W17})
SELECT event_id, n AS ordinal, subtype FROM r LEFT JOIN w ON ts BETWEEN a AND b AND port = '80' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n NULLS LAST) = 1
""")
def web_windows_2017(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows (the first counts) that only hold for port 80."""
    e = F.col("event_id")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2017-07-06 12:00:00").cast("timestamp")) + (e * 53) % 7200)
    one, two = F.lit("172.16.0.1"), F.lit("192.168.10.50")
    src, dst = F.when(e % 3 == 0, two).otherwise(one), F.when(e % 3 == 0, one).otherwise(two)
    w = A.attack_window(F.lit("Thursday-06-07-2017"), src, dst, ts, V.WEB_WINDOWS_2017, F.when(e % 4 == 0, "443").otherwise("80"))
    return read(spark, d, "events").withColumn("w", w).select("event_id", "w.ordinal", "w.subtype")


@query(f"""
WITH {_ROWS}, c AS (SELECT DISTINCT day, csv_class FROM s WHERE csv_class IN ('BruteForce', 'DoS', 'DDoS')), k AS (SELECT unnest({_list(_IPS)}) AS ip), x AS (SELECT * FROM w JOIN c ON wday = day AND klass = csv_class, k),
p AS (SELECT DISTINCT ip, attacker, victim FROM (SELECT ip, unnest(CASE WHEN NOT list_contains(vic, ip) AND list_contains(att, ip) THEN [ip] ELSE att END) AS attacker, CASE WHEN list_contains(vic, ip) THEN [ip] ELSE vic END AS v FROM x), unnest(v) AS u(victim))
SELECT 'UCAP' || ip || '.pcap' AS capture, count(*) AS pairs, sha256(string_agg('(host ' || attacker || ' and host ' || victim || ')', ' or ' ORDER BY attacker, victim)) AS filter_hash FROM p GROUP BY ip
""")
def preslice_filters(spark: SparkSession, d: str) -> DataFrame:
    captures = spark.createDataFrame([(f"UCAP{ip}.pcap", ip) for ip in _IPS], "capture string, ip string")
    pairs = A.preslice_pairs(_checked(spark, d).select("day", F.col("csv_class").alias("class_name")), captures)
    counts = pairs.groupBy("capture").agg(F.count(F.lit(1)).alias("pairs"))
    return counts.join(A.pair_filters(pairs), "capture").select("capture", "pairs", F.sha2("filter", 256).alias("filter_hash"))


@query(f"""
WITH {_ROWS} SELECT o_orderkey, CASE WHEN src IS NOT NULL THEN '(' || CASE o_orderkey % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'ip proto 47' ELSE 'ip' END || ' and src host ' || src || ' and dst host ' || dst
  || CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 7 > 0 THEN ' and src port ' || (o_orderkey % 60000) || ' and dst port ' || port ELSE '' END || ')' END AS clause FROM r
""")
def tuple_filter_clauses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    protocol = F.when(k % 4 == 0, "6").when(k % 4 == 1, "UDP").when(k % 4 == 2, "47").otherwise("x")
    src_port = F.when(k % 7 == 0, "99999").otherwise((k % 60000).cast("string"))
    return _rows(spark, d).select("o_orderkey", A.tuple_filter(F.col("src"), F.col("dst"), src_port, F.col("port"), protocol).alias("clause"))


_TUPLES = """
t AS (SELECT c_mktsegment AS capture, CASE WHEN c_custkey % 9 = 0 THEN 'none' WHEN c_custkey % 5 = 0 THEN 'fe80::' || (c_custkey % 8) ELSE '10.0.0.' || (c_custkey % 6) END AS src, '10.0.1.' || (c_custkey % 4) AS dst,
  (c_custkey % 3 + 1000)::VARCHAR AS sp, CASE WHEN c_custkey % 7 = 0 THEN '70000' ELSE '80' END AS dp, ['6', 'UDP', '47'][c_custkey % 3 + 1] AS proto FROM customer),
b AS (SELECT * FROM t UNION SELECT capture, dst, src, dp, sp, proto FROM t)
"""


@query(f"""
WITH {_TUPLES}, c AS (SELECT capture, CASE WHEN src <> 'none' AND dst <> 'none' THEN '(' || CASE proto WHEN '6' THEN 'tcp' WHEN 'UDP' THEN 'udp' ELSE 'ip proto 47' END || ' and src host ' || src || ' and dst host ' || dst
  || CASE WHEN proto <> '47' AND sp <> '70000' AND dp <> '70000' THEN ' and src port ' || sp || ' and dst port ' || dp ELSE '' END || ')' END AS clause FROM b)
SELECT capture, count(*) AS tuples, sha256(string_agg(clause, ' or ' ORDER BY clause)) AS filter_hash FROM c GROUP BY 1
""")
def candidate_filters(spark: SparkSession, d: str) -> DataFrame:
    """Capture filters of customers as candidates, both directions, repeats dropped, IPv6 addresses among them."""
    k = F.col("c_custkey")
    src = F.when(k % 9 == 0, "none").when(k % 5 == 0, F.concat(F.lit("fe80::"), (k % 8).cast("string"))).otherwise(F.concat(F.lit("10.0.0."), (k % 6).cast("string")))
    rows = read(spark, d, "customer").select(
        F.col("c_mktsegment").alias("capture"), src.alias("src"), F.concat(F.lit("10.0.1."), (k % 4).cast("string")).alias("dst"), (k % 3 + 1000).cast("string").alias("sp"),
        F.when(k % 7 == 0, "70000").otherwise("80").alias("dp"), F.array(F.lit("6"), F.lit("UDP"), F.lit("47"))[(k % 3).cast("int")].alias("proto"),
    )
    return A.candidate_filters(rows, "capture", ["src", "dst", "sp", "dp", "proto"]).select("capture", "tuples", F.sha2("filter", 256).alias("filter_hash"))


@query(f"WITH {_ROWS} SELECT DISTINCT day, 'CIC-IDS2018-' || split_part(day, '-', 1) AS source FROM r")
def source_tags(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("day").distinct().select("day", A.source_tag(F.col("day")).alias("source"))


_FLOWS = "SELECT event_id, user_id, ts, event_type, value, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events"
_SNAP = f"""
WITH e AS ({_FLOWS}), s AS (SELECT event_id, user_id % 20 AS dst, ts, CASE WHEN event_id % 3 = 0 THEN 17 WHEN event_id % 3 = 1 THEN 6 ELSE 1 END AS proto, (event_type = 'click')::INT AS syn, (event_type = 'error')::INT AS rst, k % 9 AS fin, k % 5 AS psh, k % 3 AS ack,
  CASE WHEN k % 2 = 0 THEN 80 WHEN k % 3 = 0 THEN 53 ELSE k END AS port, user_id % 6 AS sport, coalesce(value, 0.0) * 1000.0 AS dur, k % 11 + k % 4 AS packets FROM e)
SELECT event_id, {{}} FROM s WINDOW w AS (PARTITION BY event_id % 2, dst ORDER BY ts, event_id ROWS BETWEEN 375 PRECEDING AND 1 PRECEDING)
"""


def _sum(x: str) -> str:
    return f"coalesce(sum({x}) OVER w, 0)::DOUBLE"


_SQL_FEATURES = {
    "Rolling_UDP_Sum": _sum("(proto = 17)::INT"), "Rolling_TCP_Sum": _sum("(proto = 6)::INT"), "Rolling_ACK_Sum": _sum("ack"), "Rolling_FIN_Sum": _sum("fin"), "Rolling_RST_Sum": _sum("rst"), "Rolling_psh_Sum": _sum("psh"),
    "Rolling_SYN_Sum": _sum("syn"), "Rolling_ICMP_Sum": _sum("(proto = 1)::INT"), "Rolling_http_port": _sum(f"(port IN {V.HTTP_PORTS})::INT"), "Rolling_DNS_Sum": _sum("(port = 53)::INT"),
    "Rolling_vulnerable_port": _sum(f"(port IN {V.VULNERABLE_PORTS})::INT"), "Rolling_packets_Sum": _sum("packets"), "Rolling_Average_Duration": "round(coalesce(avg(dur) OVER w, 0), 5)",
    "Unique_Ports_In_SourceDestination": "(count(DISTINCT CASE WHEN sport <> 0 THEN sport END) OVER w)::DOUBLE",
}


def _flows(spark, d):
    e = read(spark, d, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)))
    i, k = F.col("event_id"), F.col("k")
    return e.select(
        "event_id", "ts", (i % 2).alias("scope"), (F.col("user_id") % 20).cast("string").alias("dst_ip"), (F.col("user_id") % 6).alias("src_port"),
        F.when(k % 2 == 0, 80).when(k % 3 == 0, 53).otherwise(k).alias("dst_port"), F.when(i % 3 == 0, 17).when(i % 3 == 1, 6).otherwise(1).alias("protocol"),
        (F.col("event_type") == "click").cast("int").alias("bidirectional_syn_packets"), (F.col("event_type") == "error").cast("int").alias("bidirectional_rst_packets"),
        (k % 9).alias("bidirectional_fin_packets"), (k % 5).alias("bidirectional_psh_packets"), (k % 3).alias("bidirectional_ack_packets"),
        F.col("value").alias("bidirectional_duration_ms"), (k % 11).alias("src2dst_packets"), (k % 4).alias("dst2src_packets"),
    )


@query(_SNAP.format(", ".join(f'{sql} AS "{name}"' for name, sql in _SQL_FEATURES.items())))
def temporal_features_full(spark: SparkSession, d: str) -> DataFrame:
    """All sums, the mean and the distinct ports over the last 375 flows to a destination, windows starting anew by scope."""
    found = T.temporal_features(T.renamed(_flows(spark, d)), ["ts", "event_id"], ["scope"])
    places = {name: V.TEMPORAL_FEATURES.index(name) for name in _SQL_FEATURES}
    return found.select("event_id", *[F.round(F.col("temporal")[i], 5).alias(name) for name, i in places.items()])


@query(f"WITH e AS ({_FLOWS}) SELECT event_id, 92::BIGINT AS width, round(k % 9 + k % 3 + k % 5 + coalesce(value, 0), 2) AS total FROM e")
def feature_vector_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The vector of 92 parts: its width, and its sum without the protocol."""
    flows = _flows(spark, d)
    known = flows.select("event_id", "bidirectional_fin_packets", "bidirectional_ack_packets", "bidirectional_psh_packets", "bidirectional_duration_ms", "protocol")
    v = T.ablated(T.feature_vector(known), "no_protocol")
    total = F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double"))
    return known.select("event_id", F.size(v).cast("bigint").alias("width"), F.round(total, 2).alias("total"))


@query("""
SELECT event_id, sha256('{"dst_ip":"10.0.0.' || (event_id % 50) || '","dst_port":' || (event_id % 7) || ',"first_seen_ms":' || epoch_ms(ts) || ',"protocol":6,"src_ip":"10.0.0.' || (user_id % 50) || '","src_port":' || (user_id % 5) || '}') AS directed,
  sha256(concat_ws('|', CASE WHEN swap THEN '10.0.0.' || (event_id % 50) ELSE '10.0.0.' || (user_id % 50) END, CASE WHEN swap THEN event_id % 7 ELSE user_id % 5 END,
    CASE WHEN swap THEN '10.0.0.' || (user_id % 50) ELSE '10.0.0.' || (event_id % 50) END, CASE WHEN swap THEN user_id % 5 ELSE event_id % 7 END, 6, epoch_ms(ts) // 1000)) AS undirected, true AS same_reversed
FROM (SELECT *, ('10.0.0.' || (event_id % 50)) < ('10.0.0.' || (user_id % 50)) OR (event_id % 50 = user_id % 50 AND event_id % 7 < user_id % 5) AS swap FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))
""")
def flow_identities(spark: SparkSession, d: str) -> DataFrame:
    """The directed hash of a flow's key, and one that both directions share."""
    i, u, ts = F.col("event_id"), F.col("user_id"), F.date_trunc("second", "ts")
    a, b = F.concat(F.lit("10.0.0."), (u % 50).cast("string")), F.concat(F.lit("10.0.0."), (i % 50).cast("string"))
    forward, back = undirected_hash(a, u % 5, b, i % 7, F.lit(6), ts, 1000), undirected_hash(b, i % 7, a, u % 5, F.lit(6), ts, 1000)
    directed = key_hash(src_ip=a, src_port=u % 5, dst_ip=b, dst_port=i % 7, protocol=F.lit(6), first_seen_ms=F.unix_millis(ts.cast("timestamp")))
    return read(spark, d, "events").select("event_id", directed.alias("directed"), forward.alias("undirected"), (forward == back).alias("same_reversed"))


_IOT = ["BenignTraffic", "Benign_Final", "DDoS-UDP_Flood", "DictionaryBruteForce", "SqlInjection", "VulnerabilityScan", "DNS_Spoofing", "mirai-new", "MQTT publish", "nothing"]


@query(f"SELECT p_partkey, {_list(_IOT)}[(p_partkey % 10 + 1)::INT] AS label, nullif(['Benign', 'Benign', 'DDoS', 'BruteForce', 'WebBased', 'Recon', 'Spoofing', 'Mirai', 'WebBased', ''][(p_partkey % 10 + 1)::INT], '') AS klass FROM part")
def iot_classes(spark: SparkSession, d: str) -> DataFrame:
    label = F.array(*[F.lit(x) for x in _IOT])[(F.col("p_partkey") % 10).cast("int")]
    return read(spark, d, "part").select("p_partkey", label.alias("label")).withColumn("klass", L.iot_class(F.col("label")))


@query("""
WITH f AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'aa' WHEN 2 THEN 'bb' ELSE 'cc' END AS s, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'bb' ELSE 'dd' END AS t, c_custkey % 2 = 0 AS benign FROM customer)
SELECT c_custkey, CASE WHEN s IS NULL AND t IS NULL THEN 'kept_missing_mac' WHEN benign AND (coalesce(s = 'bb', false) OR coalesce(t = 'bb', false)) THEN 'dropped_benign_attacker' WHEN benign THEN 'kept_benign'
  WHEN coalesce(s = 'bb', false) OR coalesce(t = 'bb', false) THEN 'kept_attack' ELSE 'dropped_attack_background' END AS decision FROM f
""")
def mac_decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = F.when(k % 5 == 1, "aa").when(k % 5 == 2, "bb").when(k % 5 > 2, "cc")
    t = F.when(k % 3 == 1, "bb").when(k % 3 == 2, "dd")
    return read(spark, d, "customer").select("c_custkey", L.mac_decision(s, t, F.array(F.lit("bb")), k % 2 == 0).alias("decision"))


_INFILTRATION = "event_id, event_id % 2 = 0 AS inside, event_id % 3 > 0 AS host, event_id % 5 > 0 AS own, CASE WHEN event_id % 7 = 0 THEN 17 ELSE 6 END AS proto, event_id % 11 AS size"


@query(f"""
SELECT event_id, CASE WHEN inside AND host AND own AND proto = 6 AND size = 0 THEN 'confirmed_zero_payload_scan_probe' WHEN inside AND host AND own AND size > 0 THEN 'matched_infiltration_with_payload' ELSE 'manual_review' END AS decision
FROM (SELECT {_INFILTRATION} FROM events)
""")
def infiltration_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    size = e % 11
    payload = F.when(size > 0, F.encode(F.lit("x"), "UTF-8")).otherwise(F.unhex(F.lit("0000")))
    ends = F.array(F.when(e % 3 > 0, "172.31.69.13").otherwise("10.0.0.1"), F.lit("10.0.0.2"))
    decision = A.infiltration_decision(
        e % 2 == 0, ends, "172.31.69.13", e % 5 > 0, F.when(e % 7 == 0, 17).otherwise(6), payload, F.array(F.lit(44), F.lit(60)), F.array(F.lit(20), F.lit(40)), F.array(size, size)
    )
    return read(spark, d, "events").select("event_id", decision.alias("decision"))


@query("""
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'primary_tuple_within_window' WHEN event_id % 7 = 0 THEN 'alternate_tuple_within_window' WHEN event_id % 5 = 0 THEN 'primary_tuple_outside_window'
  WHEN event_id % 3 = 0 THEN 'alternate_tuple_outside_window' WHEN event_id % 4 >= 2 THEN 'primary_pcap_missing' ELSE 'tuple_not_seen_in_scanned_pcaps' END AS kind FROM events
""")
def probe_classes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = A.probe_class(e % 13 == 0, e % 7 == 0, F.when(e % 5 == 0, 1.0), F.when(e % 3 == 0, -2.0), e % 4, F.lit(2))
    return read(spark, d, "events").select("event_id", kind.alias("kind"))
