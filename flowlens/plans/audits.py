"""Queries for audits, and round trips through the text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalars import micros
from flowlens.operators import audits as A
from flowlens.operators import joins as J
from flowlens.operators import neighbours as N
from flowlens.plans.catalog import query
from flowlens.plans.flows import read
from flowlens.plans.packets import scratch
from flowlens.sources import tables as T

_WEB = "CASE p_partkey % 5 WHEN 0 THEN 'Web Attack -  Brute Force' WHEN 1 THEN 'Web Attack XSS' WHEN 2 THEN 'web  attack Sql Injection' WHEN 3 THEN 'Web Attack other' ELSE p_type END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Brute Force-Web' WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQL Injection' END AS subtype FROM part")
def web_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", A.web_subtype(F.expr(_WEB)).alias("subtype"))


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' THEN 'not_infiltration' WHEN event_id % 7 = 0 THEN 'missing_timestamp' WHEN hour(ts) < 16 THEN 'early_13_14h' ELSE 'late_18_19h' END AS window_id FROM events
""")
def infiltration_windows(spark: SparkSession, d: str) -> DataFrame:
    klass = F.when(F.col("event_type") == "error", "Infiltration").otherwise("Benign")
    ts = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return read(spark, d, "events").select("event_id", A.infiltration_window(klass, ts).alias("window_id"))


@query("""
SELECT event_id, concat_ws('|', CASE WHEN event_id % 11 = 0 THEN 'flow_finite' END, CASE WHEN event_id % 13 = 0 THEN 'link_finite' END,
  CASE WHEN value / 100 = 0 OR value / 100 > 0.6 THEN 'payload_nonzero_fraction_outlier' END, CASE WHEN event_id % 17 = 0 THEN 'flow_max_nonfinite' END) AS flags FROM events
""")
def record_safety_flags(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    finite = {"flow_finite": e % 11 != 0, "link_finite": e % 13 != 0}
    highest = F.when(e % 17 == 0, float("inf")).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", F.concat_ws("|", A.safety_flags(finite, F.col("value") / 100, highest)).alias("flags"))


@query("""
SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'error'
  AND epoch_us(e.ts) BETWEEN epoch_us(w.ts) - 3600000000 AND epoch_us(w.ts) + 3600000000)
""")
def packets_in_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    hour = 3_600_000_000
    windows = e.filter("event_type = 'error'").select("user_id", (F.col("at") - hour).alias("start"), (F.col("at") + hour).alias("finish"))
    return A.in_windows(e, windows, ["user_id"], "at", "start", "finish").select("event_id")


@query("""
WITH p AS (SELECT w.event_id AS row_id, e.event_id, e.props, coalesce(sum(strlen(e.props)) OVER (PARTITION BY w.event_id ORDER BY e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM events w JOIN events e ON w.user_id = e.user_id AND abs(epoch_us(w.ts) - epoch_us(e.ts)) <= 86400000000 WHERE w.event_type = 'error')
SELECT row_id, count(*) AS n_packets, sha256(string_agg(props, chr(10) ORDER BY event_id)) AS payload_hash FROM p WHERE before < 24 GROUP BY 1
""")
def row_window_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    rows = e.filter("event_type = 'error'").select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("row_ts"))
    pairs = J.within(rows, e.select("user_id", "event_id", "props", "ts"), ["user_id"], "row_ts", "ts", 86400.0, "inner")
    return A.window_payloads(pairs, "row_id", ["event_id"], "props", 24).select("row_id", "n_packets", F.sha2("payload", 256).alias("payload_hash"))


@query("""
WITH c AS (SELECT event_type, event_id // 100 AS chunk, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, chunk, first_ts, last_ts, n, first_ts - lag(last_ts) OVER w AS gap, coalesce(first_ts < lag(last_ts) OVER w, false) AS overlaps FROM c WINDOW w AS (PARTITION BY event_type ORDER BY chunk)
""")
def chunk_chronology(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", F.floor(F.col("event_id") / 100).alias("chunk"), micros("ts").alias("at"))
    return A.chronology(e, "event_type", "chunk", "at")


@query("""
SELECT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b, epoch_us(ts) // 86400000000 AS bucket, min(event_id) AS first_id, count(*) AS seen FROM events GROUP BY 1, 2, 3
""")
def flows_seen_twice(spark: SparkSession, d: str) -> DataFrame:
    """A flow in several captures counts once: endpoints in either order and the time in steps name it."""
    other = F.col("event_id") % 50
    keyed = read(spark, d, "events").select(
        F.least("user_id", other).alias("a"), F.greatest("user_id", other).alias("b"), F.floor(micros("ts") / 86_400_000_000).alias("bucket"), "event_id"
    )
    return keyed.groupBy("a", "b", "bucket").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("seen"))


@query("""
WITH t AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, 150::BIGINT AS target, n, greatest(150 - n, 0) AS short FROM t
""")
def imbalance_report(spark: SparkSession, d: str) -> DataFrame:
    keys = ["o_orderpriority", "o_orderstatus"]
    counts = read(spark, d, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return A.imbalance(counts, counts.select(*keys, F.lit(150).cast("bigint").alias("target")), keys)


@query("""
WITH f AS (SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'P' ELSE min(l_linestatus) END AS status, min(l_shipdate)::DATE::VARCHAR AS day FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderdate::DATE::VARCHAR AS day FROM orders)
SELECT o.k AS o_orderkey, 'status' AS attribute, o.status AS expected, f.status AS found FROM o JOIN f USING (k) WHERE o.status IS DISTINCT FROM f.status
UNION ALL SELECT o.k, 'day', o.day, f.day FROM o JOIN f USING (k) WHERE o.day IS DISTINCT FROM f.day
""")
def attribute_mismatches(spark: SparkSession, d: str) -> DataFrame:
    line = F.min("l_linestatus")
    found = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(line != F.max("l_linestatus"), "P").otherwise(line).alias("status"), F.to_date(F.min("l_shipdate")).alias("day")
    )
    wanted = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"))
    return A.mismatches(wanted, found, "o_orderkey", ["status", "day"])


@query("""
WITH b AS (SELECT user_id, event_id, value, max(value) OVER w AS best, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, n - min(n) OVER (PARTITION BY user_id, best) AS stale FROM b)
SELECT user_id, event_id, value, best, stale, stale >= 3 AS stop FROM s
""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return A.early_stopping(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 3)


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, round_even(n * 14 / 20, 0)::BIGINT AS t, round_even(n * 3 / 20, 0)::BIGINT AS v FROM c),
g AS (SELECT *, greatest(n - t - v, 0) AS rest FROM r)
SELECT o_custkey, n, CASE WHEN n >= 20 THEN greatest(n - 6, 0) WHEN t < 1 THEN 1 ELSE t END AS train,
  CASE WHEN n >= 20 THEN 3 WHEN t < 1 AND rest <= 0 AND v > 0 THEN v - 1 ELSE v END AS val, CASE WHEN n >= 20 THEN 3 WHEN t < 1 AND rest > 0 THEN rest - 1 ELSE rest END AS test,
  CASE WHEN n >= 20 THEN 'fixed_targets' ELSE 'proportional_targets' END AS mode FROM g
""")
def class_split_targets(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("t", A.split_targets(F.col("n"), 14, 3, 3, 20)).select("o_custkey", "n", "t.*")


@query("""
WITH RECURSIVE g AS (SELECT lang, sha256(coalesce(text, '')) AS h, count(*) AS size FROM documents GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS n, count(*) OVER (PARTITION BY lang) AS groups, sum(size) OVER (PARTITION BY lang) AS total FROM g),
q AS (SELECT lang, h, size, n, groups, CASE WHEN total >= 100 THEN 10 ELSE round_even(total * 10 / 100, 0) END AS tv, CASE WHEN total >= 100 THEN 15 ELSE greatest(total - round_even(total * 75 / 100, 0) - round_even(total * 10 / 100, 0), 0) END AS tt FROM t),
w AS (SELECT lang, 0::BIGINT AS n, 0::HUGEINT AS val, 0::HUGEINT AS test, false AS trained, NULL::VARCHAR AS split, NULL::VARCHAR AS h FROM (SELECT DISTINCT lang FROM g)
  UNION ALL
  SELECT lang, n, CASE WHEN s = 'val' THEN val + size ELSE val END, CASE WHEN s = 'test' THEN test + size ELSE test END, trained OR s = 'train', s, h FROM (
    SELECT q.lang, q.n, q.size, q.h, w.val, w.test, w.trained, CASE WHEN q.n = q.groups AND NOT w.trained THEN 'train' WHEN w.test < q.tt AND (w.test <= w.val OR w.val >= q.tv) THEN 'test' WHEN w.val < q.tv THEN 'val' ELSE 'train' END AS s
    FROM w JOIN q ON q.lang = w.lang AND q.n = w.n + 1))
SELECT doc_id, w.split FROM documents d JOIN w ON w.lang = d.lang AND w.h = sha256(coalesce(d.text, ''))
""")
def content_atomic_split(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return A.content_split(docs, "lang", "h", 75, 10, 15, 100).select("doc_id", "split")


@query("""
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, min(lo) AS lowest, max(hi) AS highest, sum(n)::BIGINT AS n, string_agg(o_orderstatus || '=' || n, '|' ORDER BY o_orderstatus) AS histogram FROM c GROUP BY 1
""")
def subtype_ranges(spark: SparkSession, d: str) -> DataFrame:
    return A.value_ranges(read(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_orderstatus")


@query("SELECT vec_id, label, sha256(array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE * 10000, 0)::BIGINT), ',') || '|' || label) AS fingerprint FROM embeddings")
def near_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Vectors equal to four decimals, and of one label, have one fingerprint."""
    steps = F.transform("embedding", lambda x: F.bround(x.cast("double") * 10000).cast("bigint").cast("string"))
    return read(spark, d, "embeddings").select("vec_id", "label", F.sha2(F.concat(F.array_join(steps, ","), F.lit("|"), F.col("label")), 256).alias("fingerprint"))


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)
""")
def recovered_semi(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were left out come back where their key is among the recovered."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    recovered = read(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.filter("o_orderstatus <> 'F'").union(orders.filter("o_orderstatus = 'F'").join(recovered, "o_orderkey", "left_semi"))


_VARIANTS = (("full", 1, 64), ("first_half", 1, 32), ("second_half", 33, 32))


@query("""
WITH v AS (SELECT vec_id, label, 'full' AS variant, embedding::DOUBLE[] AS x FROM embeddings UNION ALL SELECT vec_id, label, 'first_half', embedding[1:32]::DOUBLE[] FROM embeddings
  UNION ALL SELECT vec_id, label, 'second_half', embedding[33:64]::DOUBLE[] FROM embeddings),
k AS (SELECT variant, q.label AS ql, r.label AS rl, row_number() OVER (PARTITION BY variant, q.vec_id ORDER BY list_cosine_distance(q.x, r.x), r.vec_id) AS rank
  FROM v q JOIN v r USING (variant) WHERE q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id)
SELECT variant, count(*) AS n, round(avg((ql = rl)::INT), 6) AS same_class FROM k WHERE rank = 1 GROUP BY 1
""")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest vector has the same label, with parts of the vector left out; ids divisible by 20 ask."""
    e = read(spark, d, "embeddings")
    near = None
    for variant, start, length in _VARIANTS:
        x = e.select("vec_id", F.slice("embedding", start, length).alias("x"))
        found = N.knn(x.filter("vec_id % 20 = 0"), x, "vec_id", "x", 1).withColumn("variant", F.lit(variant))
        near = found if near is None else near.union(found)
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    given = e.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("rl"))
    rows = near.join(asked, "query_id").join(given, "ref_id")
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ql") == F.col("rl")).cast("int")), 6).alias("same_class"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch(spark), read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    T.write_jsonl(rows, path)
    return T.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("SELECT c_custkey::VARCHAR AS id, c_mktsegment AS label FROM customer")
def csv_label_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    read(spark, d, "customer").select(F.col("c_custkey").alias(" Flow ID"), F.col("c_mktsegment").alias("Attack_Type ")).write.option("header", True).csv(path)
    rows = T.read_labelled_csv(spark, path)
    return rows.select(T.first_present(rows, ["Flow ID"]).alias("id"), F.col(T.label_column(rows.columns)).alias("label"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, ceil(count(*) / 200)::BIGINT AS least_shards, true AS small FROM orders GROUP BY 1")
def shard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    T.write_shards(read(spark, d, "orders").select("o_orderstatus", "o_orderkey"), path, "o_orderstatus", "o_orderkey", 200, 7)
    shards = spark.read.parquet(path).groupBy("o_orderstatus", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return shards.groupBy("o_orderstatus").agg(
        F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.ceil(F.sum("n") / 200).alias("least_shards"), (F.max("n") <= 200).alias("small")
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def done_registry(spark: SparkSession, d: str) -> DataFrame:
    """Work marked as done, twice, is left out of what is to do."""
    path, orders = scratch(spark), read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for _ in range(2):
        T.mark_done(orders.filter("o_orderstatus = 'F'"), path, "o_orderkey")
    return T.not_done(orders, path, "o_orderkey").select("o_orderkey")
