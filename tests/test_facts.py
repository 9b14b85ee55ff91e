"""Literal facts that the rules must reproduce, and rules against plain Python walks."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions import vocabulary as V
from flowlens.operators import attacks as A
from flowlens.operators import audits, joins, metrics, pools, sampling, scaling
from flowlens.operators import labels as L
from flowlens.operators import ordered as O
from flowlens.operators import temporal as T


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_labels(spark):
    iot = {"BenignTraffic": "Benign", "Benign_Final": "Benign", "DDoS-UDP_Flood": "DDoS", "DictionaryBruteForce": "BruteForce", "SqlInjection": "WebBased", "VulnerabilityScan": "Recon", "DNS_Spoofing": "Spoofing"}
    assert values(spark, iot, L.iot_class(F.col("x"))) == list(iot.values())
    office = {
        "BENIGN": "Benign", "FTP-BruteForce": "BruteForce", "DoS attacks-Hulk": "DoS", "DoS Hulk": "DoS", "DDOS attack-HOIC": "DDoS", "DDoS-LOIC-UDP": "DDoS",
        "Web Attack - SQL": "WebBased", "Bot": "Bot", "Infiltration": "Infiltration", "Infiltration - NMAP Portscan": "Infiltration", "odd": None, None: None,
    }
    assert values(spark, office, L.office_class(F.col("x"))) == list(office.values())
    assert values(spark, ["Web Attack - Brute Force - Attempted", "Bot", None], L.is_attempt(F.col("x"))) == [True, False, False]
    assert values(spark, ["UCAP172.31.69.25-part1.pcap", "none"], S.ip_in_name(F.col("x"))) == ["172.31.69.25", None]
    assert V.OFFICE_CLASSES == ("Benign", "BruteForce", "DoS", "DDoS", "WebBased", "Bot", "Infiltration")
    assert audits.identity_leaks(["a", "Src_IP", "flow_id"]) == ["Src_IP", "flow_id"]


def test_attack_windows(spark):
    rows = [
        ("Friday-16-02-2018", "18.219.193.20", "172.31.69.25", "2018-02-16 17:45:27.826666", "DoS", "DoS-Hulk"),
        ("Friday-16-02-2018", "172.31.69.25", "18.219.193.20", "2018-02-16 17:45:00", "DoS", "DoS-Hulk"),
        ("Friday-16-02-2018", "172.31.69.25", "18.219.193.20", "2018-02-16 18:19:00", "DoS", "DoS-Hulk"),
        ("Friday-16-02-2018", "172.31.69.25", "18.219.193.20", "2018-02-16 18:19:00.000001", None, None),
        ("Wednesday-21-02-2018", "172.31.69.28", "18.219.5.43", "2018-02-21 14:08:51.251350", None, None),
        ("Thursday-22-02-2018", "18.218.115.60", "172.31.69.28", "2018-02-22 14:17:51.336902", "WebBased", "Brute Force-Web"),
        ("Thursday-01-03-2018", "9.9.9.9", "172.31.69.13", "2018-03-01 14:00:00", "Infiltration", "Infiltration"),
        ("Friday-16-02-2018", "9.9.9.9", "172.31.69.25", "2018-02-16 17:46:00", None, None),
        ("Friday-16-02-2018", "18.219.193.20", "172.31.69.25", "not a time", None, None),
        (None, None, None, None, None, None),
    ]
    t = spark.createDataFrame(rows, "day string, src string, dst string, ts string, k string, s string").withColumns({"label": F.lit("Bot"), "port": F.lit("1"), "sent": F.lit("0")})
    found = A.crosschecked(t, "day", "src", "dst", "ts", "label", "port", "sent")
    assert "Exchange" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        assert (r.window.klass, r.window.subtype) == (r.k, r.s), r


def test_preslice(spark):
    c = spark.createDataFrame([("Friday-16-02-2018", "DoS"), ("Friday-16-02-2018", "Bot")], "day string, class_name string")
    captures = spark.createDataFrame([("UCAP172.31.69.25-part1.pcap", "172.31.69.25"), ("other.pcap", None)], "capture string, ip string")
    pairs = A.preslice_pairs(c, captures)
    mine = {(r.attacker, r.victim) for r in pairs.filter("capture like 'UCAP%'").collect()}
    assert mine == {(a, "172.31.69.25") for a in ("172.31.70.23", "13.59.126.31", "172.31.70.16", "18.219.193.20")}
    assert pairs.filter("capture = 'other.pcap'").count() == 8
    [text] = [r.filter for r in A.pair_filters(pairs).filter("capture like 'UCAP%'").collect()]
    assert "host 18.219.193.20 and host 172.31.69.25" in text and text.count(" or ") == 3
    assert values(spark, ["DoS", "Bot", None], A.needs_preslice(F.col("x"))) == [True, False, False]


def test_temporal(spark):
    flow = [("10.0.0.5", 12345, 80, 6, 3, 2, 4, 5)]
    t = spark.createDataFrame(flow, "dst_ip string, src_port int, dst_port int, protocol int, bidirectional_syn_packets int, bidirectional_duration_ms int, src2dst_packets int, dst2src_packets int")
    r = T.renamed(t).first()
    assert r["SYN Flag Cnt"] == 3 and r["Flow Duration"] == 2000.0
    two = T.renamed(t.withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))))
    rows = sorted(T.temporal_features(two, ["at"]).select("at", "temporal").collect())
    assert len(V.TEMPORAL_FEATURES) == 16 and rows[0].temporal == [0.0] * 16
    got = dict(zip(V.TEMPORAL_FEATURES, rows[1].temporal, strict=True))
    assert (got["Rolling_TCP_Sum"], got["Rolling_SYN_Sum"], got["Rolling_http_port"], got["Rolling_Average_Duration"], got["Rolling_packets_Sum"], got["Unique_Ports_In_SourceDestination"]) == (1, 3, 1, 2000, 9, 1)
    assert len(V.flow_features()) == 76


def test_identities(spark):
    t = spark.createDataFrame([("10.0.0.1", 123, "10.0.0.2", 80, 1000)], "a string, p int, b string, q int, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    forward = S.undirected_hash(F.col("a"), F.col("p"), F.col("b"), F.col("q"), F.lit(6), F.col("ts"), 1000)
    back = S.undirected_hash(F.col("b"), F.col("q"), F.col("a"), F.col("p"), F.lit(6), F.col("ts"), 1000)
    key = {"src_ip": F.col("a"), "src_port": F.col("p"), "dst_ip": F.col("b"), "dst_port": F.col("q")}
    r = t.select((forward == back).alias("same"), (S.key_hash(**key) == S.key_hash(**dict(reversed(key.items())))).alias("stable")).first()
    assert r.same and r.stable


def test_payload_helpers(spark):
    t = spark.createDataFrame([(bytes(range(32)),), (b"",), (b"x" * 2000,), (None,)], "x binary")
    sizes = [r[0] for r in t.select(F.length(pools.padded(F.col("x")))).collect()]
    assert sizes == [1500, 1500, 1500, None]
    assert t.select(S.payload_text(F.concat("x", F.unhex(F.lit("0000"))))).collect()[2][0] == "x" * 2000
    assert [r[0] for r in spark.createDataFrame([(k,) for k in range(6)], "e int").select(S.warmup_cosine(F.col("e"), 2, 4)).collect()][:3] == [0.5, 1.0, 1.0]


def test_active_periods_end_after_longer_gaps(spark):
    t = spark.createDataFrame([(k, s) for k, s in enumerate([0, 1000, 2000, 3001, 3002])], "id int, ms bigint").withColumns({"k": F.lit(1), "ts": F.timestamp_millis("ms")})
    at = [r.island for r in O.gap_islands(t, ["k"], ["ts"], "ts", 1.0, beyond=True).orderBy("id").collect()]
    assert at == [1, 1, 1, 2, 2]
    assert [r.island for r in O.gap_islands(t, ["k"], ["ts"], "ts", 1.0).orderBy("id").collect()] == [1, 2, 3, 4, 4]


def test_capped_floor():
    assert sampling.capped_floor({"a": 96, "b": 323, "c": 371}, 1771) == {"a": 590, "b": 590, "c": 591}
    assert sampling.capped_floor({"a": 5, "b": 5, "none": 0}, 10, 0.7, 0.1) == {"a": 5, "b": 5}
    assert sampling.capped_floor({c: 9 for c in "abcdefghijkl"}, 7) == {c: int(c <= "g") for c in "abcdefghijkl"}
    with pytest.raises(ValueError):
        sampling.capped_floor({"a": 0}, 10)
    rnd = random.Random(2)
    for _ in range(300):
        counts, total = {k: rnd.randrange(1, 400) for k in "abcde"[: rnd.randrange(1, 6)]}, rnd.randrange(1, 2000)
        got = sampling.capped_floor(counts, total)
        assert sum(got.values()) == total and set(got) == set(counts)
        if len(counts) > 3:
            assert max(got.values()) <= max(round(total * 0.3), round(total * 0.1)) + 1


def test_content_split(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), f"{rnd.randrange(40):03d}", k) for k in range(160)] + [("one", "x", 500), ("one", "x", 501), ("two", "x", 600), ("two", "y", 601)]
    t = spark.createDataFrame(rows, "c string, h string, id int")
    got = {(r.c, r.h): r.split for r in audits.content_split(t, "c", "h", 40, 8, 12, 60).collect()}
    for c in ("a", "b", "one", "two"):
        sizes = {}
        for k, h, _ in rows:
            if k == c:
                sizes[h] = sizes.get(h, 0) + 1
        n = sum(sizes.values())
        val, test = (8, 12) if n >= 60 else (round(n * 8 / 60), max(n - round(n * 40 / 60) - round(n * 8 / 60), 0))
        if n < 60 and round(n * 40 / 60) < 1:
            val, test = (val, test - 1) if test > 0 else (max(val - 1, 0), test)
        held, trained = {"val": 0, "test": 0}, False
        for i, h in enumerate(sorted(sizes)):
            if i == len(sizes) - 1 and not trained:
                want = "train"
            elif held["test"] < test and (held["test"] <= held["val"] or held["val"] >= val):
                want = "test"
            else:
                want = "val" if held["val"] < val else "train"
            trained |= want == "train"
            if want != "train":
                held[want] += sizes[h]
            assert got[(c, h)] == want, (c, h)


def test_match_without_a_time(spark):
    c = spark.createDataFrame([(1, "a", "b", None), (2, "b", "a", "2020-01-01 00:00:01"), (3, "q", "r", None)], "cid int, x string, y string, t string").withColumn("cts", F.col("t").cast("timestamp")).drop("t")
    f = spark.createDataFrame([(10, "a", "b", "2020-01-01 00:00:00"), (11, "a", "b", "2021-01-01 00:00:00")], "fid int, x string, y string, t string").withColumn("fts", F.col("t").cast("timestamp")).drop("t")
    got = {r.cid: r for r in joins.match_flows(c, f, ["x", "y"], [("x", "y")], "cid", "cts", "fts", "fid", 3.0, strict=False).collect()}
    assert set(got) == {1, 2} and (got[1].fid, got[1].n_matches, got[1].delta_us) == (10, 2, None) and (got[2].fid, got[2].reversed) == (10, True)


def test_errors_are_named(spark):
    t = spark.createDataFrame([("a", k) for k in range(5)], "c string, id int")
    with pytest.raises(ValueError, match="fewer"):
        sampling.exact_split(t, ["c"], "id", {"test": 4, "val": 2}, "train", 1)
    with pytest.raises(ValueError, match="b has 0 of 2"):
        pools.final_splits(t, "c", "id", [], {"a": {"train": 1, "val": 1, "test": 1}, "b": {"train": 2, "val": 0, "test": 0}}, 1)
    counts = t.groupBy("c").agg(F.count("*").alias("n"))
    with pytest.raises(ValueError, match="'b'"):
        metrics.class_weights(counts, "n", "inverse_sqrt", classes=("c", ["a", "b"]))
    with pytest.raises(ValueError, match="variant"):
        T.ablated(F.array(), "odd")


def test_quantile(spark):
    import numpy as np

    rnd = random.Random(4)
    for rows in ([3.5], [1.0, 2.0], [rnd.choice([0.0, 1.5, 7.0]) for _ in range(50)], [rnd.gauss(0, 1) for _ in range(30_000)]):
        t = spark.createDataFrame([(x,) for x in rows] + [(None,), (float("nan"),)], "x double").repartition(3)
        for q in (0.0, 0.05, 0.5, 0.99, 1.0):
            assert scaling.quantile(t, F.col("x"), q, "v").first().v == pytest.approx(np.quantile(rows, q), abs=1e-12)
    assert scaling.quantile(t.filter("false"), F.col("x"), 0.5, "v").first().v is None


def test_addresses(spark):
    import ipaddress

    texts = ["10.0.0.1", "256.1.1.1", "1.2.3", "::", "::1", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1:2:3:4::5:6:7:8", "12345::", "g::", "::ffff:1.2.3.4", "::ffff:1.2.3.400", "1:2:3:4:5:6:1.2.3.4", ":1", "1:", "", None, "FE80::AB", "a:::b"]
    got = {r.x: r.ok for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", S.is_ip(F.col("x")).alias("ok")).collect()}

    def valid(t):
        try:
            return bool(ipaddress.ip_address(t))
        except ValueError:
            return False

    assert got == {t: valid(t) for t in texts}


def test_candidate_filters(spark):
    rows = [("c", "10.0.0.1", "10.0.0.2", 5, 80, 6), ("c", "10.0.0.2", "10.0.0.1", 80, 5, 6), ("c", "fe80::1", "10.0.0.2", None, 80, 17), ("c", "nobody", "10.0.0.2", 1, 2, 6), ("d", "nobody", None, 1, 2, 6)]
    got = {r.cap: (r.filter, r.tuples) for r in A.candidate_filters(spark.createDataFrame(rows, "cap string, s string, d string, sp int, dp int, p int"), "cap", ["s", "d", "sp", "dp", "p"]).collect()}
    assert got == {
        "c": ("(tcp and src host 10.0.0.1 and dst host 10.0.0.2 and src port 5 and dst port 80) or (tcp and src host 10.0.0.2 and dst host 10.0.0.1 and src port 80 and dst port 5)"
              " or (udp and src host 10.0.0.2 and dst host fe80::1) or (udp and src host fe80::1 and dst host 10.0.0.2)", 6),
        "d": ("", 2),
    }
