"""Queries over orders, events and pages as pools of candidates: manifests, splits, folds, draws, group keys and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import pools as P
from flowlens.plans.catalog import query
from flowlens.plans.flows import read

_POOL = """
o AS (SELECT o_orderkey, o_orderstatus AS klass, o_orderpriority AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'excluded' ELSE 'accepted_label' END AS status, o_orderkey::VARCHAR AS h FROM orders),
p AS (SELECT *, status <> 'accepted_label' AS recovered_attempted, sha256(concat_ws('|', '42', 'candidate', h)) AS s FROM o WHERE status = 'accepted_label' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45))
"""


@query(f"""
WITH {_POOL}, q AS (SELECT day, 300 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY day) <= 300 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT day FROM p WHERE klass = 'O')),
r AS (SELECT p.*, row_number() OVER (PARTITION BY klass ORDER BY s, h) AS whole, row_number() OVER (PARTITION BY klass, day ORDER BY s, h) AS daily FROM p)
SELECT o_orderkey, klass, recovered_attempted FROM r LEFT JOIN q USING (day) WHERE (klass = 'O' AND daily <= quota) OR (klass = 'F' AND whole <= 250) OR (klass = 'P' AND whole <= 20)
""")
def candidate_manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("klass"), F.col("o_orderpriority").alias("day"), F.when(k % 4 == 0, "excluded").otherwise("accepted_label").alias("status"), k.cast("string").alias("flow_hash")
    )
    recovered = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("flow_hash"))
    m = P.candidate_manifest(rows, "klass", "status", "flow_hash", "day", recovered, {"O": 300, "F": 250, "P": 20}, 42, ("O",))
    return m.select("o_orderkey", "klass", "recovered_attempted")


_SIZES = {"O": {"train": 120, "val": 40, "test": 60}, "F": {"train": 200, "val": 50, "test": 50}, "P": {"train": 8, "val": 3, "test": 4}}
_NUMBER = "CAST('0x' || substring(sha256(concat_ws('|', '42', 'copy', i::VARCHAR)), 1, 12) AS BIGINT)"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS c, o_orderkey % 50 = 1 AND o_orderstatus = 'P' AS only_train FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY sha256(concat_ws('|', '42', 'final', k::VARCHAR)), k) AS n FROM o WHERE NOT only_train),
b(c, tr, va, te) AS (VALUES ('O', 120, 160, 220), ('F', 200, 250, 300), ('P', 8, 11, 15)),
s AS (SELECT k, c, CASE WHEN n <= tr THEN 'train' WHEN n <= va THEN 'val' ELSE 'test' END AS split, false AS copied, 0 AS i FROM r JOIN b USING (c) WHERE n <= te UNION ALL SELECT k, c, 'train', false, 0 FROM o WHERE only_train),
f AS (SELECT k, c, row_number() OVER (ORDER BY k) - 1 AS n, count(*) OVER () AS size FROM s WHERE c = 'P' AND split = 'train')
SELECT k AS o_orderkey, split, copied, i AS copy FROM s UNION ALL
SELECT f.k, 'train', true, i FROM (SELECT i, {_NUMBER} AS u FROM range(1, 201) t(i)) d JOIN f ON d.u % f.size = f.n WHERE i <= 200 - f.size
""")
def final_candidate_splits(spark: SparkSession, d: str) -> DataFrame:
    """Exact splits; only the scarce class's training rows are repeated up to 200."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("only", (F.col("o_orderkey") % 50 == 1) & (F.col("o_orderstatus") == "P"))
    s = P.final_splits(o, "o_orderstatus", "o_orderkey", [], _SIZES, 42, "only", {"P": 200})
    return s.select("o_orderkey", F.col("candidate_split").alias("split"), F.col("oversampled_train_reference").alias("copied"), F.col("oversample_copy_index").cast("bigint").alias("copy"))


@query("SELECT o_orderpriority AS k, list_sort(list(DISTINCT o_orderstatus)) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("candidate_split"))
    return P.split_conflicts(o, "k")


@query("""
WITH f AS (SELECT 'status_P' AS fold_id, o_orderkey AS k, o_orderstatus AS c, o_orderstatus = 'P' AS held FROM orders UNION ALL SELECT 'urgent', o_orderkey, o_orderstatus, o_orderpriority = '1-URGENT' FROM orders UNION ALL SELECT 'dear', o_orderkey, o_orderstatus, o_totalprice > 200000 FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY fold_id, c, held ORDER BY sha256(concat_ws('|', '42', 'fold', k::VARCHAR)), k) AS n FROM f)
SELECT fold_id, c AS o_orderstatus, CASE WHEN held THEN 'test' WHEN n <= 100 THEN 'val' ELSE 'train' END AS part, count(*) AS n, sum(k)::BIGINT AS keys FROM r GROUP BY ALL
""")
def fold_manifests(spark: SparkSession, d: str) -> DataFrame:
    specs = {"status_P": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority") == "1-URGENT", "dear": F.col("o_totalprice") > 200000}
    parts = P.fold_parts(P.folds(read(spark, d, "orders"), specs), "o_orderstatus", "o_orderkey", 100, 42)
    return parts.groupBy("fold_id", "o_orderstatus", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


_HEX = "CAST('0x' || substring(sha256(concat_ws('|', '42', '{}', draw::VARCHAR)), 1, 12) AS BIGINT)"


@query(f"""
WITH g AS (SELECT o_orderstatus AS c, o_orderpriority AS p, count(*) AS m FROM orders GROUP BY ALL), t AS (SELECT *, 1.0 / (3 * count(*) OVER (PARTITION BY c) * m) AS w FROM g),
b AS (SELECT *, (sum(w * m) OVER (ORDER BY c, p) - w * m) / sum(w * m) OVER () AS lo, sum(w * m) OVER (ORDER BY c, p) / sum(w * m) OVER () AS hi FROM t),
d AS (SELECT draw, {_HEX.format("group")} / 281474976710656.0 AS u, {_HEX.format("member")} AS v FROM range(2000) t(draw))
SELECT c AS o_orderstatus, p AS o_orderpriority, count(*) AS n, sum(v % m)::BIGINT AS members FROM d JOIN b ON u >= lo AND u < hi GROUP BY ALL
""")
def weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws with replacement in which classes weigh the same, and so do the groups of a class."""
    g = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("m"))
    per = g.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("groups"))
    g = g.join(per, "o_orderstatus").withColumn("w", 1.0 / (3 * F.col("groups") * F.col("m")))
    out = P.weighted_draws(g, "w", "m", 2000, 42, ["o_orderstatus", "o_orderpriority"])
    return out.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("member").alias("members"))


_SRC = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE 'CIC-IDS2018-' || event_type END"
_BEGIN = "CASE WHEN event_id % 3 = 0 THEN '2018-02-14 14:32:00' END"


@query(f"""
WITH r AS (SELECT event_id, coalesce(nullif({_SRC}, ''), 'unknown') AS s, coalesce({_BEGIN}, '') AS b, CASE WHEN event_id % 7 = 0 THEN 'missing_pcap' ELSE 'cap' || (user_id % 4) || '.pcap' END AS cap, 'sub' || (user_id % 3) AS kind, user_id FROM events)
SELECT event_id, CASE WHEN b <> '' THEN concat_ws('|', s, 'day', 'DoS', kind, b, '') ELSE concat_ws('|', s, 'day', 'DoS', kind, cap) END AS window_key,
  concat_ws('|', s, 'day', CASE WHEN event_id % 2 = 0 THEN 'a' || user_id ELSE 'unknown' END, 'b', '80', 'unknown') AS endpoint_key FROM r
""")
def group_keys(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    source = F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, "").otherwise(F.concat(F.lit("CIC-IDS2018-"), "event_type"))
    start = F.when(e % 3 == 0, "2018-02-14 14:32:00")
    capture = P.capture_name(F.when(e % 7 > 0, F.concat(F.lit("/data/cap"), (u % 4).cast("string"), F.lit(".pcap"))), F.lit(""))
    kind = P.subtype(F.lit(""), F.concat(F.lit("sub"), (u % 3).cast("string")), F.lit("x"))
    none = F.lit(None).cast("string")
    ends = P.endpoint_key(source, F.lit("day"), [F.when(e % 2 == 0, F.concat(F.lit("a"), u.cast("string"))), none], [none, F.lit("b")], F.lit(80), none)
    return read(spark, d, "events").select("event_id", P.window_key(source, F.lit("day"), F.lit("DoS"), kind, start, none, capture).alias("window_key"), ends.alias("endpoint_key"))


@query("""
SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.source) AS source, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def record_enrichment(spark: SparkSession, d: str) -> DataFrame:
    records = read(spark, d, "documents").select("doc_id", "source")
    found = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("source"), "toxic")
    return P.enriched(records, found, "doc_id", ["source", "toxic"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'ftp_bruteforce_attempted_stress_set' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 1 THEN 'dos_slowhttptest_attempted_stress_set' END AS stress_set,
  substring(sha256(concat_ws('|', 'work', o_orderkey::VARCHAR)), 1, 16) AS work FROM orders
""")
def stress_sets(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    klass = F.when(s == "F", "BruteForce").when(s == "O", "DoS").otherwise("Bot")
    kind = F.when(k % 3 == 0, "FTP-BruteForce").when(k % 3 == 1, "DoS-SlowHTTPTest").otherwise("other")
    return read(spark, d, "orders").select("o_orderkey", P.stress_set(klass, kind).alias("stress_set"), P.work_id(F.lit("work"), k).alias("work"))


_BYTES = "(SELECT list_sum([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, length(h) // 2)]))"


@query(f"""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN '00' || hex(substr(text, 1, 40)) || repeat('00', 60) ELSE hex(substr(text, 1, 200)) END AS h FROM conversations WHERE turn % 7 <> 6),
p AS (SELECT conv_id, role, length(h) // 2 AS size, {_BYTES} AS total, len(list_filter([substr(h, 2 * i + 1, 2) FOR i IN range(0, length(h) // 2)], lambda x: x <> '00')) AS filled FROM c),
r AS (SELECT conv_id, role, sum(total) / 255.0 / sum(size) AS mean, sum(filled) / sum(size) AS nonzero, count(*) FILTER (filled > 0) / count(*) AS rows FROM p GROUP BY 1, 2),
k AS (SELECT CASE WHEN role = 'user' THEN 'WebBased' ELSE 'Benign' END AS class_name, count(*) AS records, round(avg(mean), 6) AS mean_value, round(max(mean), 6) AS most_value, round(avg(nonzero), 6) AS mean_nonzero, round(min(nonzero), 6) AS least_nonzero, round(avg(rows), 6) AS mean_rows_with_payload FROM r GROUP BY 1)
SELECT *, CASE WHEN mean_nonzero < 0.1 THEN 'nearly_all_zero' WHEN mean_nonzero < 0.8 THEN 'sparse' ELSE 'dense' END AS interpretation, CASE WHEN class_name = 'WebBased' AND mean_value < 0.1 THEN 'below_gate' ELSE 'adequate' END AS gate FROM k
""")
def payload_density(spark: SparkSession, d: str) -> DataFrame:
    """Each text's beginning as a packet, every fifth one between zero bytes, every seventh one not captured at all."""
    c = read(spark, d, "conversations")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    some = F.when(F.col("turn") % 5 == 4, F.concat(zeros(1), F.encode(F.substring("text", 1, 40), "UTF-8"), zeros(60))).otherwise(F.encode(F.substring("text", 1, 200), "UTF-8"))
    packet = F.struct(F.when(F.col("turn") % 7 != 6, some).alias("bytes"))  # a null is kept as an element
    records = c.groupBy("conv_id", "role").agg(F.collect_list(packet)["bytes"].alias("payloads")).filter(F.exists("payloads", lambda b: b.isNotNull()))
    out = P.payload_diagnostic(records.withColumn("klass", F.when(F.col("role") == "user", "WebBased").otherwise("Benign")), "klass", "payloads")
    numbers = ("mean_value", "most_value", "mean_nonzero", "least_nonzero", "mean_rows_with_payload")
    return out.select("class_name", "records", *[F.round(n, 6).alias(n) for n in numbers], "interpretation", "gate")


@query("""
WITH f AS (SELECT l_orderkey, count(*) AS nodes, sum(l_quantity)::BIGINT AS packets FROM lineitem GROUP BY 1)
SELECT count(*) AS records, count(*) FILTER (packets > 100 AND nodes <= 100) AS mismatches, round(avg((packets > 100 AND nodes <= 100)::INT), 6) AS share, max(packets) AS most_packets, max(nodes) AS most_nodes, CASE WHEN count(*) FILTER (packets > 100 AND nodes <= 100) > 0 THEN 'mismatch_confirmed_rebuild_needed' ELSE 'no_mismatch_observed_flowcapper_consistent' END AS conclusion FROM f
""")
def flow_window_consistency(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("nodes"), F.sum("l_quantity").cast("bigint").alias("packets"))
    return P.window_consistency(f, "packets", "nodes", 100).withColumn("share", F.round("share", 6))


@query("""
WITH a AS (SELECT 'text' AS attribute, html AS b FROM pages WHERE html IS NOT NULL UNION ALL SELECT 'link', url FROM pages WHERE url IS NOT NULL)
SELECT attribute, count(*) AS seen, count(*) FILTER (b <> '') AS nonzero, round(avg(octet_length(encode(b))), 4) AS mean_length, max(octet_length(encode(b)))::BIGINT AS most_length FROM a GROUP BY 1
""")
def packet_attributes(spark: SparkSession, d: str) -> DataFrame:
    probe = P.attribute_probe(read(spark, d, "pages"), {"text": F.encode("html", "UTF-8"), "link": F.encode("url", "UTF-8")})
    return probe.select("attribute", "seen", "nonzero", F.round("mean_length", 4).alias("mean_length"), F.col("most_length").cast("bigint").alias("most_length"))


@query("""
SELECT page_id, 1500::BIGINT AS size, least(octet_length(encode(url)), 1500)::BIGINT AS used, CASE WHEN octet_length(encode(url)) = 0 THEN '#d7dee7' WHEN octet_length(encode(url)) / 100.0 < 0.25 THEN '#4dab8c' ELSE '#f59f00' END AS colour FROM pages WHERE octet_length(encode(url)) >= 10
""")
def padded_payloads(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").filter(F.octet_length("url") >= 10)
    fixed = P.padded(F.encode("url", "UTF-8"))
    used = F.length(F.regexp_replace(F.hex(fixed), "(00)+$", "")) / 2
    return p.select("page_id", F.length(fixed).cast("bigint").alias("size"), used.cast("bigint").alias("used"), P.brightness(F.octet_length("url") / 100.0).alias("colour"))


@query("SELECT o_orderstatus, min(l) AS label, row_number() OVER (ORDER BY min(l) NULLS LAST, o_orderstatus) - 1 AS place FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 7 END AS l FROM orders) GROUP BY 1")
def class_order(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 7).alias("l"))
    return P.class_order(o, "o_orderstatus", "l").withColumn("place", F.col("place").cast("bigint"))


@query("""
WITH f AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS candidates, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS matched FROM lineitem GROUP BY 1)
SELECT l_suppkey, candidates, matched, round(matched / candidates, 6) AS yield FROM f
""")
def yield_per_capture(spark: SparkSession, d: str) -> DataFrame:
    matched = F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")))
    f = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("candidates"), matched.alias("matched"))
    return f.withColumn("yield", F.round(F.col("matched") / F.col("candidates"), 6))


@query("""
WITH c AS (SELECT o_orderpriority AS day, count(*) AS rows, count(DISTINCT o_custkey) AS files, count(*) - count(DISTINCT o_custkey) AS repeated FROM orders GROUP BY 1)
SELECT day, rows, files, repeated, coalesce(e.events, 0) AS events FROM c LEFT JOIN (SELECT CASE event_type WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' END AS day, count(*) AS events FROM events GROUP BY 1) e USING (day)
""")
def preflight_per_day(spark: SparkSession, d: str) -> DataFrame:
    """What there is of each day: rows, files, files met again, and packets of another source."""
    files = F.count_distinct("o_custkey")
    c = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("day")).agg(F.count(F.lit(1)).alias("rows"), files.alias("files"), (F.count(F.lit(1)) - files).alias("repeated"))
    kind = F.when(F.col("event_type") == "click", "1-URGENT").when(F.col("event_type") == "view", "2-HIGH")
    e = read(spark, d, "events").groupBy(kind.alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return c.join(e, "day", "left").withColumn("events", F.coalesce("events", F.lit(0)))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders ORDER BY place LIMIT 500")
def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 candidates by day, time and identity, numbered."""
    top = read(spark, d, "orders").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(500)
    order = M.Window.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")  # 500 rows
    return top.select("o_orderkey", F.row_number().over(order).cast("bigint").alias("place"))
