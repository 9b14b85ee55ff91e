"""Queries over documents, orders, parts, labels and embeddings: labels, hashes, samples, splits, metrics, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.vocabulary import PAYLOAD_PATTERNS
from flowlens.operators import joins as J
from flowlens.operators import labels as L
from flowlens.operators import metrics as M
from flowlens.operators import neighbours as N
from flowlens.operators import ordered as O
from flowlens.operators import sampling as P
from flowlens.operators import scaling as C
from flowlens.plans.catalog import query
from flowlens.plans.flows import read
from flowlens.scratch import cut


@query("""
SELECT p_partkey, regexp_replace(lower(trim(p_name || ' - ' || p_type)), '[^a-z0-9]+', '', 'g') AS compacted, trim(regexp_replace(p_name || '   ' || p_brand, '\\s+', ' ', 'g')) AS squeezed FROM part
""")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat("p_name", F.lit(" - "), "p_type")
    return read(spark, d, "part").select("p_partkey", S.compact(both).alias("compacted"), S.squeezed(F.concat("p_name", F.lit("   "), "p_brand")).alias("squeezed"))


_RAW = "CASE o_orderkey % 9 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'FTP-BruteForce' WHEN 2 THEN 'DoS attacks-Hulk' WHEN 3 THEN 'DDOS attack-HOIC' WHEN 4 THEN 'Web Attack - SQL' WHEN 5 THEN 'Web Attack - XSS - Attempted' WHEN 6 THEN 'Infiltration - NMAP Portscan' WHEN 7 THEN 'Bot' ELSE 'something else' END"


@query(f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, {_RAW} AS label FROM orders),
k AS (SELECT *, CASE label WHEN 'BENIGN' THEN 'Benign' WHEN 'FTP-BruteForce' THEN 'BruteForce' WHEN 'DoS attacks-Hulk' THEN 'DoS' WHEN 'DDOS attack-HOIC' THEN 'DDoS' WHEN 'Bot' THEN 'Bot'
  WHEN 'something else' THEN NULL WHEN 'Infiltration - NMAP Portscan' THEN 'Infiltration' ELSE 'WebBased' END AS klass FROM r)
SELECT o_orderkey, klass, CASE WHEN klass IS NULL THEN 'unknown_label' WHEN contains(lower(label), 'attempted') THEN 'excluded_attempted_or_non_success'
  WHEN klass = 'BruteForce' AND o_orderstatus = 'F' THEN 'excluded_closed_port' WHEN klass = 'BruteForce' AND o_totalprice < 20000 THEN 'excluded_no_payload' ELSE 'accepted_label' END AS status FROM k
""")
def label_decision_list(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "orders").withColumn("label", F.expr(_RAW)).withColumn("klass", L.office_class(F.col("label")))
    brute = F.col("klass") == "BruteForce"
    rules = [(brute & (F.col("o_orderstatus") == "F"), "excluded_closed_port"), (brute & (F.col("o_totalprice") < 20000), "excluded_no_payload")]
    return r.select("o_orderkey", "klass", L.label_status(F.col("label"), rules, F.col("klass")).alias("status"))


@query("""
SELECT event_id, sha256(concat_ws('|', user_id::VARCHAR, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'))) AS flow_hash,
 sha256(concat_ws('|', least(user_id, event_id % 150)::VARCHAR, greatest(user_id, event_id % 150)::VARCHAR, floor(epoch_us(ts) / 1000 / 60000)::BIGINT::VARCHAR)) AS pair_hash FROM events
""")
def hash_flow_key(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("user_id"), F.col("event_id") % 150
    return read(spark, d, "events").select(
        "event_id", S.stable_hash(a, F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("flow_hash"),
        S.stable_hash(F.least(a, b), F.greatest(a, b), F.floor(S.micros("ts") / 1000 / 60000)).alias("pair_hash"),
    )


@query("""
WITH m AS (SELECT c_custkey, printf('%X-%02x-%02X-%02x-%02X-%x', c_custkey % 16, c_custkey % 256, (c_custkey * 7) % 256, (c_custkey * 11) % 256, (c_custkey * 13) % 256, c_nationkey % 16) AS raw FROM customer)
SELECT c_custkey, array_to_string(list_transform(string_split(lower(raw), '-'), lambda x: lpad(x, 2, '0')), ':') AS mac FROM m
""")
def mac_normalise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.format_string("%X-%02x-%02X-%02x-%02X-%x", k % 16, k % 256, (k * 7) % 256, (k * 11) % 256, (k * 13) % 256, F.col("c_nationkey") % 16)
    return read(spark, d, "customer").select("c_custkey", S.normal_mac(raw).alias("mac"))


@query("""
WITH i AS (SELECT c_custkey, concat_ws('.', (CASE c_custkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 8 WHEN 4 THEN 127 ELSE 169 END)::VARCHAR, (CASE WHEN c_custkey % 12 < 6 THEN 168 ELSE 16 + c_custkey % 40 END)::VARCHAR, (c_custkey % 300)::VARCHAR, '1') AS ip FROM customer)
SELECT c_custkey, ip, c_custkey % 300 < 256 AND (c_custkey % 6 IN (0, 4) OR (c_custkey % 6 = 1 AND c_custkey % 12 >= 6 AND 16 + c_custkey % 40 BETWEEN 16 AND 31) OR (c_custkey % 6 = 2 AND c_custkey % 12 < 6)) AS private FROM i
""")
def private_ip(spark: SparkSession, d: str) -> DataFrame:
    ip = F.expr("concat_ws('.', CASE c_custkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 8 WHEN 4 THEN 127 ELSE 169 END, CASE WHEN c_custkey % 12 < 6 THEN 168 ELSE 16 + c_custkey % 40 END, c_custkey % 300, '1')")
    return read(spark, d, "customer").select("c_custkey", ip.alias("ip")).withColumn("private", S.is_private_ip(F.col("ip")))


@query("""
SELECT o_orderkey, round(coalesce(bytes / nullif(n, 0), 0), 6) AS mean_size, round(ln(1 + bytes / greatest(n, 1)), 6) AS log_size, round(coalesce(bytes / nullif(o_totalprice, 0), 0), 6) AS ratio
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS bytes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def derived_rates_log1p(spark: SparkSession, d: str) -> DataFrame:
    flows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("bytes"))
    mean = S.safe_divide(F.col("bytes"), F.col("n"))
    return read(spark, d, "orders").join(flows, "o_orderkey").select(
        "o_orderkey", F.round(mean, 6).alias("mean_size"), F.round(S.capped_log(mean), 6).alias("log_size"), F.round(S.safe_divide(F.col("bytes"), F.col("o_totalprice")), 6).alias("ratio")
    )


@query("""
WITH t AS (SELECT *, o_orderkey % 10 < 7 AS train FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps FROM t WHERE train)
SELECT o_orderkey, round(sum((l_quantity - qm) / qs), 5) AS quantity, round(sum((l_extendedprice - pm) / ps), 5) AS price FROM t, f GROUP BY 1
""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    known = line.join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    fitted = C.fit_standard(known, cols, F.col("l_orderkey") % 10 < 7)
    return C.scaled(known, cols, fitted).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 5).alias("quantity"), F.round(F.sum("l_extendedprice"), 5).alias("price"))


@query("""
WITH f AS (SELECT CASE WHEN quantile_cont(o_totalprice, 0.99) <= 0 THEN 1.0 ELSE quantile_cont(o_totalprice, 0.99) END AS p FROM orders WHERE o_orderkey % 10 < 7)
SELECT o_orderkey, round(o_totalprice / greatest(p, 1.0), 6) AS scaled FROM orders, f
""")
def p99_scale(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    fitted = C.fit_p99(o, "o_totalprice", F.col("o_orderkey") % 10 < 7)
    return o.crossJoin(F.broadcast(fitted)).select("o_orderkey", F.round(F.col("o_totalprice") / F.greatest("p99", F.lit(1.0)), 6).alias("scaled"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most, len(v) AS n FROM e
""")
def compact_vector_stats(spark: SparkSession, d: str) -> DataFrame:
    facts = read(spark, d, "embeddings").select("vec_id", S.array_facts(F.col("embedding")).alias("f"), F.size("embedding").cast("bigint").alias("n"))
    return facts.select("vec_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("mean", "std", "least", "most")], "n")


@query("""
WITH p AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id % 3 <> 0)
SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM p GROUP BY 1
""")
def fit_positions(spark: SparkSession, d: str) -> DataFrame:
    f = C.fit_positions(read(spark, d, "embeddings"), "embedding", F.col("vec_id") % 3 != 0)
    return f.select(F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT vec_id, round(list_sum([CASE WHEN i IN (1, 2, 5) THEN 0 ELSE embedding[i]::DOUBLE END FOR i IN range(1, len(embedding) + 1)]), 5) AS total FROM embeddings")
def feature_vector_masked(spark: SparkSession, d: str) -> DataFrame:
    m = C.masked(F.col("embedding"), [0, 1, 4])
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_SPLIT = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END"


@query(f"""
WITH k AS (SELECT DISTINCT {_SPLIT} AS split, sha256(text) AS h FROM documents)
SELECT x.split AS a, y.split AS b, count(*) AS shared FROM k x JOIN k y ON x.h = y.h AND x.split < y.split GROUP BY 1, 2
""")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "documents").select(F.expr(_SPLIT).alias("split"), F.sha2("text", 256).alias("h"))
    return P.split_overlap(k, "split", "h")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', '42', 'take', doc_id::VARCHAR)), doc_id) <= 10")
def stable_take(spark: SparkSession, d: str) -> DataFrame:
    return P.stable_take(read(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 10, 42, "take")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256(concat_ws('|', '7', 'reservoir', event_id::VARCHAR)), event_id) <= 100")
def reservoir_by_key(spark: SparkSession, d: str) -> DataFrame:
    return P.stable_take(read(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id", 100, 7, "reservoir")


@query("""
WITH s AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderpriority FROM orders)),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(concat_ws('|', '42', '', o_orderkey::VARCHAR)), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority, (503 // n + CASE WHEN k <= 503 % n THEN 1 ELSE 0 END) AS quota FROM r JOIN s ON p = o_orderpriority WHERE rn <= 503 // n + CASE WHEN k <= 503 % n THEN 1 ELSE 0 END
""")
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    return P.stratified(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 503, 42).select("o_orderkey", "o_orderpriority", F.col("quota").cast("bigint").alias("quota"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256(concat_ws('|', '42', 'split', o_orderkey::VARCHAR)), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= 300 THEN 'test' WHEN rn <= 700 THEN 'val' ELSE 'train' END AS split FROM r
""")
def hash_split_exact(spark: SparkSession, d: str) -> DataFrame:
    return P.exact_split(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", {"test": 300, "val": 400}, "train", 42, strict=False)


@query("""
WITH s AS (SELECT o_orderstatus AS k, o_custkey AS g, count(*) AS size FROM orders GROUP BY 1, 2),
h AS (SELECT *, sha256(concat_ws('|', '42', 'group', k, g::VARCHAR)) AS h FROM s),
r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY k) AS groups, sum(size) OVER (PARTITION BY k) AS total, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WINDOW w AS (PARTITION BY k ORDER BY size, h)),
t AS (SELECT *, groups >= 3 AND n <= groups - 2 AND (n = 1 OR before < round_even(total * 0.1, 0)) AS test FROM r),
u AS (SELECT *, sum(test::INT) OVER (PARTITION BY k) AS tg, sum(CASE WHEN test THEN size ELSE 0 END) OVER (PARTITION BY k) AS tr FROM t)
SELECT k AS o_orderstatus, g AS o_custkey, size, CASE WHEN test THEN 'test' WHEN n <= groups - 1 AND (n - tg = 1 OR before - tr < round_even(total * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM u
""")
def group_exclusive_split(spark: SparkSession, d: str) -> DataFrame:
    return P.group_split(read(spark, d, "orders"), "o_orderstatus", "o_custkey", 0.1, 42)


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(concat_ws('|', '42', 'balance', c_custkey::VARCHAR)), c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, c_nationkey, unnest(range(0, (60 - rn) // n + 1)) AS copy FROM r WHERE rn <= 60
""")
def balance_to_target(spark: SparkSession, d: str) -> DataFrame:
    b = P.balance(read(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 60, 42)
    return b.select("c_custkey", "c_nationkey", F.col("copy").cast("bigint").alias("copy"))


@query("SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256(concat_ws('|', '42', 'cap', o_orderkey::VARCHAR)), o_orderkey) <= 25")
def campaign_cap(spark: SparkSession, d: str) -> DataFrame:
    return P.stable_take(read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 25, 42, "cap")


@query("""
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, 1.0 / n AS a, 1 / sqrt(n) AS b, 0.001 / (1 - pow(0.999, n)) AS e FROM c)
SELECT p_type, n, round(least(a / avg(a) OVER (), 10), 6) AS inverse_frequency, round(least(b / avg(b) OVER (), 10), 6) AS inverse_sqrt, round(least(e / avg(e) OVER (), 10), 6) AS effective_number FROM r
""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    for method in ("inverse_frequency", "inverse_sqrt", "effective_number"):
        w = M.class_weights(w, "n", method, beta=0.999, cap=10.0).withColumnRenamed("weight", method)
    return w


@query("""
WITH s AS (SELECT p_type, p_brand, p_size, count(*) AS size FROM part GROUP BY ALL), g AS (SELECT p_type, p_brand, count(*) AS groups FROM s GROUP BY ALL), t AS (SELECT p_type, count(*) AS subtypes FROM g GROUP BY ALL)
SELECT p_type, p_brand, p_size, round(1.0 / ((SELECT count(*) FROM t) * subtypes * groups * size), 9) AS weight FROM s JOIN g USING (p_type, p_brand) JOIN t USING (p_type)
""")
def hierarchical_sample_weights(spark: SparkSession, d: str) -> DataFrame:
    return M.hierarchical_weights(read(spark, d, "part"), "p_type", "p_brand", "p_size").withColumn("weight", F.round("weight", 9))


@query("SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(read(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred")), "truth", "pred")


_TP = "SELECT o_orderstatus AS t, CASE WHEN o_totalprice % 7 < 4 THEN o_orderstatus WHEN o_totalprice % 7 < 5.5 THEN 'F' ELSE 'P' END AS p, o_orderpriority AS g FROM orders"
_CELLS = f"""
WITH r AS ({_TP}), k AS (SELECT DISTINCT t AS k FROM r),
m AS (SELECT g, k, count(*) FILTER (t = k) AS support, count(*) FILTER (p = k) AS predicted, count(*) FILTER (t = k AND p = k) AS tp, count(*) AS total FROM r, k GROUP BY GROUPING SETS ((k), (g, k)))
"""


def _predicted(spark, d):
    o = read(spark, d, "orders")
    x = F.col("o_totalprice") % 7
    p = F.when(x < 4, F.col("o_orderstatus")).when(x < 5.5, "F").otherwise("P")
    return o.select(F.col("o_orderstatus").alias("t"), p.alias("p"), F.col("o_orderpriority").alias("g"))


@query(_CELLS + """
SELECT k AS klass, support, predicted, tp, predicted - tp AS fp, support - tp AS fn, total - support - predicted + tp AS tn, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall,
 round(2 * tp / (support + predicted), 6) AS f1, round((predicted - tp) / (total - support), 6) AS fpr, round((support - tp) / support, 6) AS fnr FROM m WHERE g IS NULL
""")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = M.class_metrics(_predicted(spark, d), "t", "p")
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "fpr", "fnr")})


@query(_CELLS + "SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(2 * tp / (support + predicted)), 6) AS macro_f1, round(sum(support * 2 * tp / (support + predicted)) / sum(support), 6) AS weighted_f1 FROM m WHERE g IS NULL")
def macro_weighted_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(_predicted(spark, d), "t", "p").withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "weighted_f1")})


@query(_CELLS + "SELECT g, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(2 * tp / (support + predicted)), 6) AS macro_f1, round(sum(support * 2 * tp / (support + predicted)) / sum(support), 6) AS weighted_f1 FROM m WHERE g IS NOT NULL GROUP BY g")
def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(_predicted(spark, d), "t", "p", ["g"]).withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "weighted_f1")})


@query(f"SELECT t, g, count(*) AS n, round(avg((t = p)::INT), 6) AS recall FROM ({_TP}) GROUP BY 1, 2")
def subtype_recall(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("t") == F.col("p")).cast("int")), 6).alias("recall"))


@query(f"SELECT g, count(*) FILTER (t = 'F' AND p = 'F') AS tp, count(*) FILTER (t <> 'F' AND p = 'F') AS fp, count(*) FILTER (t = 'F' AND p <> 'F') AS fn FROM ({_TP}) WHERE t = 'F' OR p = 'F' GROUP BY g")
def source_stratified(spark: SparkSession, d: str) -> DataFrame:
    t, p = F.col("t") == "F", F.col("p") == "F"
    return _predicted(spark, d).filter(t | p).groupBy("g").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


# One cell of one draw: the rest of its rows that are left, the chance q of the rarer outcome, its uniform v, and the count.
_Z = "(CASE WHEN v < 0.5 THEN -1 ELSE 1 END * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)))"
_BOOT = f"""
WITH RECURSIVE r AS ({_TP}), c AS (SELECT t, p, count(*) AS n, row_number() OVER (ORDER BY t, p) - 1 AS i, sum(count(*)) OVER (ORDER BY t DESC, p DESC) AS rest FROM r GROUP BY 1, 2),
u AS (SELECT b, i, n, rest, (('0x' || substr(sha256(concat_ws('|', '42', b, i)), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u, n / rest AS p FROM c, (SELECT unnest(range(200)) AS b)),
v AS (SELECT *, CASE WHEN p > 0.5 THEN 1 - p ELSE p END AS q, CASE WHEN p > 0.5 THEN 1 - u ELSE u END AS v, sqrt(-2 * ln(least(u, 1 - u))) AS t FROM u),
draws AS (
  SELECT b, -1::BIGINT AS i, (SELECT sum(n) FROM c)::BIGINT AS remaining, 0::BIGINT AS k FROM (SELECT unnest(range(200)) AS b)
  UNION ALL
  SELECT b, i, remaining - k, k FROM (SELECT b, i, remaining, CASE WHEN n >= rest THEN remaining WHEN p > 0.5 THEN remaining - rare ELSE rare END AS k FROM (
    SELECT d.b, v.i, v.n, v.rest, v.p, d.remaining, CASE WHEN d.remaining = 0 THEN 0 WHEN d.remaining * q < 100 THEN
      least(d.remaining, list_reduce(range(1, greatest(1, least(d.remaining, ceil(d.remaining * q + 12 * sqrt(d.remaining * q + 1) + 12)))::BIGINT + 1),
        lambda s, k: CASE WHEN s.total >= v THEN s ELSE {{'k': k, 'prob': s.prob * (d.remaining - k + 1) / k * (q / (1 - q)), 'total': s.total + s.prob * (d.remaining - k + 1) / k * (q / (1 - q))}} END,
        {{'k': 0::BIGINT, 'prob': pow(1 - q, d.remaining), 'total': pow(1 - q, d.remaining)}}).k)
      ELSE greatest(0, least(d.remaining, floor(d.remaining * q + {_Z} * sqrt(d.remaining * q * (1 - q)) + (1 - 2 * q) * ({_Z} * {_Z} - 1) / 6 + 0.5)))::BIGINT END AS rare
    FROM draws d JOIN v ON v.b = d.b AND v.i = d.i + 1))
), s AS (SELECT b, t, p, k AS n FROM draws JOIN c USING (i) WHERE k > 0),
per AS (SELECT b, y, 2.0 * sum(n) FILTER (t = p AND y = t AND side) / sum(n) AS f1 FROM (SELECT b, t, p, n, t AS y, true AS side FROM s UNION ALL SELECT b, t, p, n, p, false FROM s) GROUP BY 1, 2),
m AS (SELECT b, avg(coalesce(f1, 0)) AS f FROM per GROUP BY 1)
SELECT round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.5), 6) AS middle, round(quantile_cont(f, 0.975), 6) AS high FROM m
"""


@query(_BOOT)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return M.bootstrap_macro_f1(_predicted(spark, d), "t", "p", 200, 42).select(*[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query(f"SELECT round(quantile_cont(x, 0.05), 6) AS threshold FROM (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'F')")
def ood_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.low_confidence_threshold(read(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").withColumn("threshold", F.round("threshold", 6))


_NEAR = """
WITH p AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, q.label AS ql, r.label AS rl, list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), ref_id) AS rank FROM p)
"""


_EVERY = _NEAR.replace(" WHERE q.vec_id % 20 = 0", "")  # all rows ask


def _nearest(spark, d, k):
    """Neighbours of all rows, written once as they are read several times."""
    e = read(spark, d, "embeddings")
    return e, cut(N.knn(e, e, "vec_id", "embedding", k), "near")


@query(_EVERY + "SELECT query_id, ref_id, round(d, 6) AS distance, rank FROM k WHERE rank <= 5")
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return N.knn(e, e, "vec_id", "embedding", 5).select("query_id", "ref_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(_NEAR + "SELECT query_id, ref_id, round(d, 6) AS distance, rank FROM k WHERE rank <= 5")
def knn_pruned_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    near, _ = N.knn_pruned(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return near.select("query_id", "ref_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


_SAME = {"class": "label", "subtype": "kind", "day": "day", "window": "part", "pcap": "file", "endpoint_service": "service"}


@query(_EVERY + """, a AS (SELECT d, ql::VARCHAR AS klass, (query_id % 3)::VARCHAR AS kind, ql = rl AS s1, query_id % 3 = ref_id % 3 AS s2, query_id % 5 = ref_id % 5 AS s3, query_id % 2 = ref_id % 2 AS s4, query_id % 7 = ref_id % 7 AS s5, query_id % 4 = ref_id % 4 AS s6 FROM k WHERE rank = 1)
SELECT CASE WHEN grouping(klass) = 1 THEN 'all' WHEN grouping(kind) = 1 THEN 'class' ELSE 'subtype' END AS level, klass AS class_name, kind AS subtype, count(*) AS count,
  round(avg(s1::INT), 6) AS same_class_rate, round(avg(s2::INT), 6) AS same_subtype_rate, round(avg(s3::INT), 6) AS same_day_rate, round(avg(s4::INT), 6) AS same_window_rate, round(avg(s5::INT), 6) AS same_pcap_rate, round(avg(s6::INT), 6) AS same_endpoint_service_rate,
  count(*) FILTER (d <= 0.001) AS distance_le_0_001, count(*) FILTER (d <= 0.01) AS distance_le_0_01, count(*) FILTER (d <= 0.05) AS distance_le_0_05,
  round(min(d), 6) AS distance_min, round(quantile_cont(d, 0.01), 6) AS distance_p01, round(quantile_cont(d, 0.05), 6) AS distance_p05, round(quantile_cont(d, 0.5), 6) AS distance_median, round(quantile_cont(d, 0.95), 6) AS distance_p95, round(max(d), 6) AS distance_max
FROM a GROUP BY GROUPING SETS ((), (klass), (klass, kind))
""")
def neighbour_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours in all, by class and by subtype: percentiles, agreement of six attributes, counts within three distances."""
    e, near = _nearest(spark, d, 1)
    i = F.col("vec_id")
    facts = {"label": F.col("label"), "kind": i % 3, "day": i % 5, "part": i % 2, "file": i % 7, "service": i % 4}
    q = e.select(i.alias("query_id"), *[c.alias(n) for n, c in facts.items()])
    r = e.select(i.alias("ref_id"), *[c.alias(f"ref_{n}") for n, c in facts.items()])
    pairs = N.agreement(near.join(q, "query_id").join(r, "ref_id"), _SAME)
    pairs = pairs.withColumn("same_class", F.col("label") == F.col("ref_label"))  # not known where a label is not
    out = N.neighbour_summary(pairs, "distance", "label", "kind", [f"same_{n}" for n in _SAME])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_rate") or c in N.PERCENTILES})


@query(_EVERY + "SELECT ql AS label, count(*) AS n, round(avg((ql = rl)::INT), 6) AS same_class, round(quantile_cont(d, 0.5), 6) AS median_distance FROM k WHERE rank <= 5 GROUP BY 1")
def nn_agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    e, near = _nearest(spark, d, 5)
    q = e.select(F.col("vec_id").alias("query_id"), "label")
    r = e.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("rl"))
    rows = near.join(q, "query_id").join(r, "ref_id")
    medians = C.grouped_quantiles(rows, ["label"], "distance", {"m": 0.5}).select(F.col("label").alias("of"), F.round("m", 6).alias("median_distance"))
    rates = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("rl")).cast("int")), 6).alias("same_class"))
    return rates.join(medians, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


@query(_NEAR + "SELECT query_id, round(min(d) FILTER (ql = rl), 6) AS own, round(min(d) FILTER (ql <> rl), 6) AS other, round(min(d) FILTER (ql <> rl) - min(d) FILTER (ql = rl), 6) AS margin FROM k GROUP BY 1")
def knn_margin(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    m = N.class_margins(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", "label")
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("own", "other", "margin")])


@query("""
WITH c AS (SELECT o_custkey % 40 AS g, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT k, sum(n) AS n FROM c GROUP BY 1),
f AS (SELECT g, t.k, coalesce(max(c.n) FILTER (c.k = t.k), 0) AS own, t.n - coalesce(max(c.n) FILTER (c.k = t.k), 0) AS rest FROM c, t GROUP BY g, t.k, t.n)
SELECT g, sum(own)::BIGINT AS held_out, sum(rest)::BIGINT AS remaining, min(rest)::BIGINT AS least_class, CASE WHEN min(rest) <= 0 THEN 'invalid' WHEN sum(own) < 375 OR sum(rest) < 1000 THEN 'weak' ELSE 'runnable' END AS status FROM f GROUP BY g
""")
def holdout_feasibility(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("g"), "o_orderstatus")
    return M.complement_counts(o, "g", "o_orderstatus", ["F", "O", "P"], 1000, 375)


@query("SELECT o_orderstatus, arg_max(k, {'n': n, 'k': -k}) AS largest, round(max(n) / sum(n), 6) AS share, count(*) AS groups, sum(least(n, 50))::BIGINT AS capped FROM (SELECT o_orderstatus, o_custkey % 50 AS k, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "orders").groupBy("o_orderstatus", (F.col("o_custkey") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("o_orderstatus").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count(F.lit(1)).alias("groups"), F.sum(F.least("n", F.lit(50))).alias("capped"))


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 5")
def heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return O.first_per_key(g, ["event_type"], [F.desc("n"), "user_id"], 5)


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(avg((o_totalprice > 100000)::INT), 6) AS kept FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_kept(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_totalprice") > 100000).cast("int")), 6).alias("kept"))
    return r.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "kept")


@query("""
WITH r AS (SELECT doc_id, unnest([CASE WHEN text IS NULL OR text = '' THEN 'empty' END, CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END]) AS reason FROM documents)
SELECT reason, count(*) AS n, min(doc_id) AS sample FROM r WHERE reason IS NOT NULL GROUP BY 1
""")
def gate_rules(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    rules = {"empty": F.coalesce(F.col("text") == "", F.lit(True)), "length": F.col("n_chars") != F.length("text"), "short": F.col("n_chars") < 100, "language": ~F.col("lang").isin("en", "de")}
    r = t.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("sample"))


_HITS = ", ".join(f"CASE WHEN regexp_matches(lower(html), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in PAYLOAD_PATTERNS["sql"].items())


@query(f"SELECT page_id, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), '|') AS hits, CASE WHEN len(list_filter([{_HITS}], lambda x: x IS NOT NULL)) > 0 THEN 'recover' WHEN trim(html) <> '' THEN 'manual_review' ELSE 'keep_excluded' END AS decision FROM pages")
def payload_signatures(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").withColumn("h", L.payload_hits("sql", F.col("html")))
    return p.select("page_id", F.array_join("h", "|").alias("hits"), L.payload_decision(F.col("h"), F.col("html")).alias("decision"))


@query("SELECT conv_id, turn, substring(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), 1, 220) AS excerpt FROM conversations")
def payload_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", S.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    left, _ = J.with_misses(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])
    status = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "good").otherwise("bad")
    return left.groupBy("lang", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def metadata_misses(spark: SparkSession, d: str) -> DataFrame:
    return J.with_misses(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id"), ["doc_id"])[1]


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def missing_coverage(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return read(spark, d, "nation").select("n_nationkey").exceptAll(seen.distinct())


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_join_check(spark: SparkSession, d: str) -> DataFrame:
    return J.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH a AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer), b AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier)
SELECT c_custkey, s_suppkey, a.place FROM a JOIN b ON c_nationkey = s_nationkey AND a.place = b.place
""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    b = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return J.positional(a, b, ["k"], ["c_custkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey", F.col("place").cast("bigint").alias("place"))


@query("""
WITH s AS (SELECT c_custkey, c_nationkey AS a, (c_custkey * 7) % 25 AS b, c_custkey % 3 = 0 AS pa, c_custkey % 4 = 0 AS pb FROM customer), n AS (SELECT s_nationkey AS k, count(*) AS files FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN x.files IS NULL AND y.files IS NULL THEN 'none' WHEN y.files IS NULL THEN CASE WHEN x.files > 1 THEN 'src_only_multi_part' ELSE 'src_only' END
 WHEN x.files IS NULL THEN CASE WHEN y.files > 1 THEN 'dst_only_multi_part' ELSE 'dst_only' END WHEN pa AND NOT pb THEN CASE WHEN x.files > 1 THEN 'private_src_multi_part' ELSE 'private_src' END
 ELSE CASE WHEN y.files > 1 THEN 'dst_preferred_multi_part' ELSE 'dst_preferred' END END AS choice FROM s LEFT JOIN n x ON x.k = a LEFT JOIN n y ON y.k = b
""")
def endpoint_choice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), ((k * 7) % 25).cast("int").alias("b"))
    n = read(spark, d, "supplier").filter("s_suppkey % 3 = 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("files"))
    x, y = (n.select(F.col("s_nationkey").alias(c), F.col("files").alias(f"{c}_files")) for c in "ab")
    j = s.join(x, "a", "left").join(y, "b", "left")
    return j.select("c_custkey", L.endpoint_choice(F.col("a_files"), F.col("b_files"), k % 3 == 0, k % 4 == 0).alias("choice"))


@query("""
SELECT o_orderkey, l_linenumber AS node, 'contains' AS edge, l_quantity AS attr FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, l_linenumber, 'rev_contains', l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def edges_from_flows(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return j.select("o_orderkey", F.col("l_linenumber").alias("node"), F.explode(F.array(F.lit("contains"), F.lit("rev_contains"))).alias("edge"), F.col("l_quantity").alias("attr"))


@query("SELECT label, round(avg(list_avg(embedding::DOUBLE[])), 6) AS pooled FROM embeddings GROUP BY 1")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(S.array_facts(F.col("embedding"))["mean"]), 6).alias("pooled"))


@query("SELECT doc_id, first FROM (SELECT doc_id, 'labels' AS first FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def first_wins_union(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "labels").select("doc_id", F.lit("labels").alias("first"))
    b = read(spark, d, "documents").select("doc_id", F.lit("documents").alias("first"))
    return J.first_wins([a, b], ["doc_id"], ["first"]).select("doc_id", "first")


@query("""
WITH a AS (SELECT quality, row_number() OVER (ORDER BY sha256(concat_ws('|', '42', 'permute', doc_id)), doc_id) AS r FROM labels),
b AS (SELECT quality AS shuffled, row_number() OVER (ORDER BY sha256(concat_ws('|', '42', 'permute labels', doc_id)), doc_id) AS r FROM labels)
SELECT count(*) AS n, sum(shuffled)::BIGINT AS ones, round(avg((quality = shuffled)::INT), 6) AS agreement FROM a JOIN b USING (r)
""")
def permuted_labels(spark: SparkSession, d: str) -> DataFrame:
    p = P.permuted_labels(read(spark, d, "labels"), "doc_id", "quality", 42)
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum("shuffled_label").alias("ones"), F.round(F.avg((F.col("quality") == F.col("shuffled_label")).cast("int")), 6).alias("agreement"))


# Shares of 1,000 for counts(name, n), round by round.
_CAPPED = """
st AS (SELECT list(name ORDER BY n DESC, name DESC) AS names, list(n ORDER BY n DESC, name DESC) AS c, count(*) AS k FROM counts),
lim AS (SELECT *, least(round_even(1000 * 0.10, 0)::BIGINT, 1000) AS low, greatest(round_even(1000 * 0.30, 0)::BIGINT, round_even(1000 * 0.10, 0)::BIGINT) AS high FROM st),
r AS (
  SELECT 0 AS round, names, c, k, high, [low FOR x IN c] AS g FROM lim WHERE low * k <= 1000
  UNION ALL
  SELECT round + 1, names, c, k, high, CASE WHEN list_sum(more) = 0 THEN [g[i] + rest // k + (i <= rest % k)::BIGINT FOR i IN range(1, k + 1)] ELSE [g[i] + more[i] FOR i IN range(1, k + 1)] END
  FROM (SELECT *, [whole[i] + (up[i] AND len(list_filter(range(1, k + 1), lambda j: up[j] AND (part[j] > part[i] OR part[j] = part[i] AND j < i))) < rest - list_sum(whole))::BIGINT FOR i IN range(1, k + 1)] AS more
    FROM (SELECT *, [able[i] AND g[i] + whole[i] < high FOR i IN range(1, k + 1)] AS up, [share[i] - floor(share[i]) FOR i IN range(1, k + 1)] AS part
      FROM (SELECT *, [CASE WHEN able[i] THEN least(floor(share[i])::BIGINT, high - g[i]) ELSE 0 END FOR i IN range(1, k + 1)] AS whole
        FROM (SELECT *, [CASE WHEN able[i] THEN rest * (c[i] / list_sum([CASE WHEN able[j] THEN c[j] ELSE 0 END FOR j IN range(1, k + 1)])) ELSE 0 END FOR i IN range(1, k + 1)] AS share
          FROM (SELECT *, 1000 - list_sum(g)::BIGINT AS rest, [x < high FOR x IN g] AS able FROM r WHERE list_sum(g) < 1000)))))
), dealt AS (SELECT unnest(names) AS name, unnest(g) AS quota FROM r QUALIFY round = max(round) OVER ()),
even AS (SELECT name, 1000 // count(*) OVER () + (row_number() OVER (ORDER BY name) <= 1000 % count(*) OVER ())::BIGINT AS quota FROM counts, lim WHERE low * k > 1000)
SELECT name AS {name}, quota::BIGINT AS quota FROM (FROM dealt UNION ALL FROM even)
"""


def _shares(counts: DataFrame, name: str) -> DataFrame:
    """The shares of 1,000 for counts(name, n); they are worked out on the driver, from 10,000 names at most."""
    rows = counts.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("there are more than 10,000 names to share among")
    shares = P.capped_floor({r[name]: r.n for r in rows}, 1000)
    return counts.sparkSession.createDataFrame(sorted(shares.items()), f"{name} string, quota bigint")


@query("WITH RECURSIVE counts AS (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1), " + _CAPPED.format(name="p_type"))
def capped_floor_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _shares(read(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type")


_SKEW = "CASE WHEN o_orderkey % 100 < 60 THEN 'a' WHEN o_orderkey % 100 < 85 THEN 'b' WHEN o_orderkey % 100 < 95 THEN 'c' WHEN o_orderkey % 100 < 99 THEN 'd' ELSE 'e' END"


@query(f"WITH RECURSIVE counts AS (SELECT {_SKEW} AS name, count(*) AS n FROM orders GROUP BY 1), " + _CAPPED.format(name="kind"))
def capped_floor_skewed(spark: SparkSession, d: str) -> DataFrame:
    """Classes from a hundredth to three fifths of the rows: floors, a ceiling, and what it leaves."""
    return _shares(read(spark, d, "orders").groupBy(F.expr(_SKEW).alias("kind")).agg(F.count(F.lit(1)).alias("n")), "kind")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def two_level_counts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).fillna(0)
    return p.select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))
