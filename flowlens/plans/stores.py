"""Queries over stores, gates and per-flow hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalars import micros
from flowlens.operators import flows as W
from flowlens.operators import gates as G
from flowlens.plans.catalog import query
from flowlens.plans.flows import read
from flowlens.plans.packets import scratch
from flowlens.sources import manifests as M
from flowlens.sources import stores as T


@query("SELECT c_mktsegment AS day, '/d/improved/' || c_mktsegment || '.csv' AS improved_csv, '/d/original/' || c_mktsegment || '_TrafficForML_CICFlowMeter.csv' AS original_csv, '/d/raw/' || c_mktsegment || '/pcap' AS captures FROM customer GROUP BY ALL")
def day_paths(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "customer").select(F.col("c_mktsegment").alias("day")).distinct()
    return days.withColumn("p", T.day_paths(F.col("day"), "/d/")).select("day", "p.*")


@query("""
WITH f AS (SELECT o_orderkey, 'flood' || chr((97 + o_custkey % 5)::INT) AS subtype, o_totalprice > 150000 AS big FROM orders), c AS (SELECT *, count(*) FILTER (NOT big) OVER (PARTITION BY subtype) AS chunks FROM f)
SELECT o_orderkey, subtype, CASE WHEN NOT big THEN 'use' WHEN chunks > 0 THEN 'skipped_has_chunks' ELSE 'skipped_needs_split' END AS status, row_number() OVER (PARTITION BY subtype ORDER BY o_orderkey) - 1 AS place FROM c
""")
def capture_discovery(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("/raw/flood"), F.expr("char(97 + o_custkey % 5)"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".pcap"))
    files = read(spark, d, "orders").select("o_orderkey", name.alias("path"), F.ceil("o_totalprice").alias("size"))
    found = T.discovered(files, 150000)
    return found.select("o_orderkey", "subtype", "status", F.col("place").cast("bigint").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 > 0")
def independent_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 3 == 0, "/x/CIC_IDS_2018/").otherwise("/x/other/"), k.cast("string"), F.when(k % 4 == 0, ".PCAP").when(k % 4 == 1, ".csv").otherwise(".txt"))
    return T.independent(read(spark, d, "orders").select("o_orderkey", path.alias("path")), ["cic_ids_2018", "cicids2017"]).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, sha256(concat_ws('|', o_orderpriority, o_orderstatus, o_orderkey::VARCHAR)) AS graph_id FROM orders WHERE o_orderpriority = '5-LOW' QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 40")
def record_store(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    T.write_records(read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), path, "o_orderpriority", "o_orderstatus", "o_orderkey")
    return T.read_records(spark, path, "o_orderpriority", "5-LOW", "o_orderstatus", 40).select("o_orderkey", "o_orderstatus", "graph_id")


@query("SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END)::BIGINT AS keys FROM orders GROUP BY 1")
def regenerated_parts(spark: SparkSession, d: str) -> DataFrame:
    """One class of a pool made anew; the others stay."""
    path, o = scratch(spark), read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    T.replace_parts(o, path, ["o_orderstatus"])
    T.replace_parts(o.filter("o_orderstatus = 'P'").withColumn("o_orderkey", -F.col("o_orderkey")), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT event_id, event_type AS day, value FROM events")
def temporal_index(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    T.write_index(read(spark, d, "events").select("event_id", F.col("event_type").alias("day"), "value"), path, 375)
    return T.read_index(spark, path, 375).select("event_id", "day", "value")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderkey % 10 > 0) AS good, count(*) FILTER (o_orderkey % 10 = 0) AS rejected FROM orders GROUP BY 1")
def reconciled_pool(spark: SparkSession, d: str) -> DataFrame:
    """Records that can be read and lines that cannot, from the files of a pool."""
    path, k = scratch(spark), F.col("o_orderkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("{broken "), "o_orderstatus")).otherwise(F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    read(spark, d, "orders").select(line.alias("value")).write.text(path)
    good, bad = T.reconciled(spark, path, "o_orderkey bigint, o_orderstatus string")
    counts = good.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("good"))
    rejects = bad.groupBy(F.substring_index("text", " ", -1).alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("rejected"))
    return counts.join(rejects, "o_orderstatus", "full").select("o_orderstatus", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("""
WITH r AS (SELECT o_orderkey AS id, unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'missing_required_file' END, CASE WHEN o_orderkey % 7 = 0 THEN 'pcap_read_check_error' END, CASE WHEN o_orderkey % 7 = 1 THEN 'pcap_read_check_skipped' END, CASE WHEN o_orderkey % 11 = 0 THEN 'sha256_skipped' END]) AS reason FROM orders)
SELECT reason, reason IN ('missing_required_file', 'pcap_read_check_error') AS hard, count(*) AS n, list_sort(list(id))[1:3] AS sample FROM r WHERE reason IS NOT NULL GROUP BY 1
""")
def gate_raw_data(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = read(spark, d, "orders").select(
        "o_orderkey", F.lit(True).alias("required"), (k % 5 > 0).alias("exists"), (k % 11 > 0).alias("hashed"), F.when(k % 7 == 0, "error").when(k % 7 == 1, "skipped").otherwise("ok").alias("read_check")
    )
    return G.report(G.broken(files, "o_orderkey", *G.registry_rules("pcap")), 3)


@query("""
WITH r AS (SELECT vec_id AS id, unnest([CASE WHEN vec_id % 50 = 0 THEN 'missing_candidate_identity' END, CASE WHEN label > 6 THEN 'unknown_class_name' END, CASE WHEN label <= 6 AND vec_id % 9 = 0 AND label <> 0 THEN 'label_class_mismatch' END,
  CASE WHEN vec_id % 8 = 0 THEN 'feature_version_mismatch' END, CASE WHEN vec_id % 6 = 0 THEN 'flow_dim_mismatch' END, CASE WHEN vec_id % 25 = 0 THEN 'packet_count_out_of_range' END, CASE WHEN vec_id % 25 > 0 AND vec_id % 4 = 0 THEN 'packet_dim_mismatch' END,
  CASE WHEN vec_id % 3 = 0 AND vec_id % 25 > 0 THEN 'link_edge_shape_mismatch' END, CASE WHEN vec_id % 12 = 1 THEN 'flow_nonfinite' END]) AS reason FROM embeddings)
SELECT count(*) > 0 AS failed, count(*) AS hard_failures, 0::BIGINT AS warnings, count(DISTINCT reason) AS reasons FROM r WHERE reason IS NOT NULL
""")
def gate_records(spark: SparkSession, d: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    classes = ["c0", "c1", "c2", "c3", "c4", "c5", "c6"]
    n = F.when(i % 25 == 0, 0).otherwise(3)
    flow = F.when(i % 6 == 0, F.array_repeat(F.lit(1.0), 64)).otherwise(F.concat(F.array(F.when(i % 12 == 1, float("nan")).otherwise(0.5)), F.array_repeat(F.lit(1.0), 91)))
    body = F.unhex(F.repeat(F.lit("00"), F.when(i % 4 == 0, 10).otherwise(1500)))
    records = read(spark, d, "embeddings").select(
        "vec_id", F.when(i % 50 > 0, i.cast("string")).alias("candidate_identity"), F.concat(F.lit("c"), label.cast("string")).alias("class_name"), F.when(i % 9 == 0, 0).otherwise(label).alias("label"),
        F.when(i % 8 > 0, "v2").alias("flow_feature_version"), flow.alias("flow_x"), F.array_repeat(body, n).alias("packet_x"),
        F.array_repeat(F.array_repeat(F.lit(1.0), 4), n).alias("contain_edge_attr"), F.array_repeat(F.lit(0.0), F.greatest(n - 1, F.lit(0)) + F.when((i % 3 == 0) & (i % 25 > 0), 1).otherwise(0)).alias("link_edge_attr"),
    )
    found = G.broken(records, "vec_id", G.record_rules(classes, "v2"))
    reasons = found.agg(F.count_distinct("reason").alias("reasons"))
    v = G.verdict(found)
    return v.crossJoin(reasons).select((F.col("status") == "fail").alias("failed"), "hard_failures", "warnings", "reasons")  # one row each


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, sha256(text) AS h, source FROM documents),
l AS (SELECT doc_id AS id, 'h_shared_by_splits' AS reason FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(DISTINCT split) > 1) UNION ALL SELECT doc_id, 'source_shared_by_splits' FROM s WHERE source IN (SELECT source FROM s GROUP BY source HAVING count(DISTINCT split) > 1))
SELECT reason, count(*) AS n, min(id) AS first_id FROM l GROUP BY 1
""")
def gate_split_leakage(spark: SparkSession, d: str) -> DataFrame:
    split = F.expr("CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END")
    s = read(spark, d, "documents").select("doc_id", split.alias("split"), F.sha2("text", 256).alias("h"), "source")
    r = G.report(G.leaks(s, "split", ["h", "source"], "doc_id"), 1)
    return r.select("reason", "n", F.col("sample")[0].alias("first_id"))


@query("""
WITH t AS (SELECT o_orderstatus AS class_name, count(*) AS n, count(*) FILTER (o_orderkey % 10 = 0) AS more FROM orders GROUP BY 1)
SELECT class_name, n AS rows_then, n + more AS rows_now FROM t
""")
def pool_against_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A pool is digested into its manifest, then rows are added to it: counts by the manifest, and rebuilt from the files."""
    path, orders = scratch(spark), read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.parquet(path)
    M.write_manifest(spark, path, "o_orderstatus")
    orders.filter("o_orderkey % 10 = 0").write.mode("append").parquet(path)
    return M.reconcile(spark, path, "o_orderstatus")[1]


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'done' END AS outcome, count(*) AS n, sum(CASE WHEN c_custkey % 3 > 0 THEN c_custkey END)::BIGINT AS keys FROM customer GROUP BY 1")
def batched_pool(spark: SparkSession, d: str) -> DataFrame:
    """Customers in batches of a bounded cost, one run stopped after a batch and taken up again: outcomes, and what is in the pool."""
    path, k = scratch(spark), F.col("id").cast("bigint")
    work = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1).cast("double").alias("cost"))
    [total] = work.agg(F.sum("cost")).first()

    def step(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return batch.filter(k % 3 > 0).select("id"), batch.select("id", F.when(k % 3 == 0, "rejected").otherwise("done").alias("outcome"))

    for most in (1, None):
        M.run_batches(work, path, step, total / 2.5, 1 << 20, most)
    pool = spark.read.parquet(f"{path}/pool").select("id", k.alias("key"))
    return M.registry(spark, path).join(pool, "id", "left").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


_GATE7 = """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split, CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS own,
  CASE WHEN o_orderkey % 31 = 0 THEN 'CICIDS2017' ELSE 'other-2018' END AS source, CASE WHEN o_orderkey % 83 > 0 THEN (o_orderkey // 3)::VARCHAR END AS identity, CASE WHEN o_orderkey % 89 > 0 THEN (o_custkey % 400)::VARCHAR ELSE '' END AS hash,
  CASE WHEN o_orderkey % 101 > 0 THEN o_orderkey::VARCHAR END AS graph, CASE WHEN o_orderkey % 10 >= 8 AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS klass FROM orders),
rules AS (SELECT unnest([CASE WHEN own <> split THEN 'graph_split_attr_mismatch' END, CASE WHEN source LIKE '%2017%' AND split <> 'train' THEN 'cicids2017_graph_outside_train' END, CASE WHEN identity IS NULL THEN 'missing_office_candidate_identity' END,
  CASE WHEN hash = '' THEN 'missing_flow_id_hash' END, CASE WHEN graph IS NULL THEN 'missing_graph_id' END]) AS reason, 1 AS n FROM r),
dups AS (SELECT 'duplicate_identity' AS reason, count(*) - 1 AS n FROM r WHERE identity IS NOT NULL GROUP BY identity HAVING count(*) > 1 UNION ALL SELECT 'duplicate_graph', count(*) - 1 FROM r WHERE graph IS NOT NULL GROUP BY graph HAVING count(*) > 1),
over AS (SELECT 'cross_split_identity_overlap' AS reason, 1 AS n FROM (SELECT DISTINCT identity AS v, split FROM r WHERE identity IS NOT NULL) a JOIN (SELECT DISTINCT identity AS v, split FROM r) b ON a.v = b.v AND a.split < b.split
  UNION ALL SELECT 'cross_split_hash_overlap', 1 FROM (SELECT DISTINCT hash AS v, split FROM r WHERE hash <> '') a JOIN (SELECT DISTINCT hash AS v, split FROM r) b ON a.v = b.v AND a.split < b.split),
expected AS (SELECT s.split, c.klass FROM (SELECT unnest(['train', 'val', 'test']) AS split) s, (SELECT unnest(['F', 'O', 'P', 'X']) AS klass) c),
gone AS (SELECT 'class_missing_from_split' AS reason, 1 AS n FROM expected w WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.split || r.klass) = (w.split || w.klass)))
SELECT reason, sum(n)::BIGINT AS n FROM (FROM rules UNION ALL FROM dups UNION ALL FROM over UNION ALL FROM gone) WHERE reason IS NOT NULL GROUP BY 1
"""


@query(_GATE7)
def gate_split_full(spark: SparkSession, d: str) -> DataFrame:
    """The leakage gate in full: rules of records, repeated and shared identities, hashes and graph ids, classes missing from a split."""
    k = F.col("o_orderkey")
    split = F.when(k % 10 < 6, "train").when(k % 10 < 8, "val").otherwise("test")
    r = read(spark, d, "orders").select(
        "o_orderkey", split.alias("split"), F.when(k % 97 == 0, "").otherwise(split).alias("own"), F.when(k % 31 == 0, "CICIDS2017").otherwise("other-2018").alias("source"),
        F.when(k % 83 > 0, F.floor(k / 3).cast("string")).alias("identity"), F.when(k % 89 > 0, (F.col("o_custkey") % 400).cast("string")).otherwise("").alias("hash"), F.when(k % 101 > 0, k.cast("string")).alias("graph"),
        F.when((k % 10 >= 8) & (F.col("o_orderstatus") == "P"), "O").otherwise(F.col("o_orderstatus")).alias("klass"),
    )
    rules = G.split_rules("split", "own", "source", "identity", "hash", "graph")
    failures, _ = G.pool_gate(r, "o_orderkey", "split", rules, unique=["identity", "graph"], apart=["identity", "hash", "graph"], expected=("klass", ["F", "O", "P", "X"], ["train", "val", "test"], True))
    return G.gate_report(failures, 3).select("reason", "n")


@query("""
WITH r AS (SELECT vec_id AS k, label, CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM embeddings),
rules AS (SELECT unnest([CASE WHEN k % 50 = 0 THEN 'missing_graph_id' END, CASE WHEN label > 6 THEN 'unknown_class_name' END, CASE WHEN k % 9 = 0 AND label BETWEEN 1 AND 6 THEN 'label_class_mismatch' END, CASE WHEN k % 7 = 0 THEN 'node_type_mismatch' END,
  CASE WHEN k % 25 NOT IN (0, 1) AND k % 8 = 0 THEN 'edge_type_missing' END, CASE WHEN k % 6 = 0 THEN 'flow_dim_mismatch' END, CASE WHEN k % 25 = 0 OR k % 4 = 3 THEN 'packet_dim_mismatch' END,
  CASE WHEN k % 12 = 1 THEN 'flow_x_nonfinite' END]) AS reason, 1 AS n FROM r)
SELECT reason, sum(n)::BIGINT AS n, reason <> 'class_missing_from_split' AS hard FROM (
  FROM rules UNION ALL SELECT 'duplicate_graph_id', count(*) - 1 FROM r WHERE k % 50 > 0 GROUP BY k // 2 HAVING count(*) > 1
  UNION ALL SELECT 'class_missing_from_split', 1 FROM (SELECT s.split, c.klass FROM (SELECT unnest(['train', 'val']) AS split) s, (SELECT unnest(range(8)) AS klass) c) w WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.split || r.label) = (w.split || w.klass))
) WHERE reason IS NOT NULL GROUP BY 1
""")
def gate_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The graph gate: ids, classes, node and edge types, dimensions, finite values; a class missing from a split is a warning here."""
    k, label = F.col("vec_id"), F.col("label")
    n = F.when(k % 25 == 0, 0).when(k % 25 == 1, 1).otherwise(3)
    types = F.when((k % 8 == 0) | (n < 2), F.array(F.lit("contains"), F.lit("rev_contains"))).otherwise(F.array(F.lit("contains"), F.lit("rev_contains"), F.lit("linked_to")))
    flow = F.when(k % 6 == 0, F.array_repeat(F.lit(1.0), 64)).otherwise(F.concat(F.array(F.when(k % 12 == 1, float("nan")).otherwise(0.5)), F.array_repeat(F.lit(1.0), 91)))
    r = read(spark, d, "embeddings").select(
        "vec_id", F.when(k % 4 == 0, "val").otherwise("train").alias("split"), F.when(k % 50 > 0, F.floor(k / 2).cast("string")).alias("graph_id"), label.cast("string").alias("class_name"), F.when(k % 9 == 0, 0).otherwise(label).alias("label"),
        F.when(k % 7 == 0, F.array(F.lit("flow"))).otherwise(F.array(F.lit("packet"), F.lit("flow"))).alias("node_types"), types.alias("edge_types"), F.array(flow).alias("flow_x"),
        F.array_repeat(F.array_repeat(F.lit(0.5), F.when(k % 4 == 3, 7).otherwise(8)), n).alias("packet_x"), F.array_repeat(F.array_repeat(F.lit(1.0), 4), n).alias("contain_edge_attr"),
        F.array_repeat(F.array(F.lit(0.0)), F.greatest(n - 1, F.lit(0))).alias("link_edge_attr"),
    )
    failures, _ = G.pool_gate(r, "vec_id", "split", G.graph_rules([str(c) for c in range(7)], packet=8), unique=["graph_id"], expected=("class_name", list(range(8)), ["train", "val"], False))
    return G.gate_report(failures, 3).select("reason", "n", "hard")


@query("SELECT vec_id AS id, 'embedding_width' AS reason FROM embeddings WHERE vec_id % 7 = 0")
def model_widths(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return G.wrong_widths(e, "vec_id", {"embedding": 64}).select("id", "reason")


@query("SELECT label, pos, round(avg(x), 6) AS pooled FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL")
def mean_pool_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label, position by position."""
    p = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return p.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("pooled"))


def _packets(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("flow"), micros("ts").alias("ts_us"), F.col("event_id").alias("seq"), "event_type", "value")


@query("""
WITH f AS (SELECT user_id, arg_min(event_type, {'t': ts, 'i': event_id}) AS first_type FROM events GROUP BY 1)
SELECT event_id AS seq FROM events JOIN f USING (user_id) WHERE first_type IN ('click', 'error')
""")
def first_packet_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("click",), ("error",)], "event_type string")
    return W.of_first_packets(_packets(spark, d), ["flow"], wanted, ["event_type"]).select("seq")


def _longest_run(rows: pd.DataFrame) -> dict:
    kinds = rows["event_type"].tolist()
    best = run = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return {"n_packets": len(kinds), "longest": best}


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
g AS (SELECT user_id, event_type, island, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id AS flow, sum(n)::BIGINT AS n_packets, max(n) AS longest FROM g GROUP BY 1
""")
def flow_plugin(spark: SparkSession, d: str) -> DataFrame:
    """A user's function over each flow's packets: the longest run of one kind."""
    return W.with_plugin(_packets(spark, d), ["flow"], ["ts_us", "seq"], _longest_run, "n_packets bigint, longest bigint")


@query("""
WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS seg FROM events), p AS (SELECT user_id, seg, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id AS flow, seg AS segment_index, n AS n_packets, CASE WHEN seg < max(seg) OVER (PARTITION BY user_id) THEN 'packet_limit' ELSE 'flow_end' END AS reason, max(seg) OVER (PARTITION BY user_id) = 0 AS is_full_flow FROM p
""")
def segment_facts(spark: SparkSession, d: str) -> DataFrame:
    return W.segment_facts(_packets(spark, d), ["flow"], ["ts_us", "seq"], 20)
