"""Emission order, audits of attempted rows, and flows of rows without a time, against worked cases and plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens.operators import emission, halo, joins
from flowlens.operators import payloads as P

T0 = datetime(2018, 2, 16, 10)


def at(s):
    return T0 + timedelta(seconds=s)


def test_emission_differs_from_time(spark):
    """A long quiet flow leaves before one that opened earlier and is still busy; what is left leaves in opening order."""
    flows = [("f", 1, 0, 900), ("f", 2, 5, 5), ("f", 3, 6, 400), ("f", 4, 300, 300), ("f", 5, 950, 960), ("g", 6, 0, 10), ("none", 7, 0, 1)]
    packets = [("f", s) for s in (0, 5, 6, 100, 125, 300, 400, 421, 520, 700, 900, 950, 960)] + [("g", 0), ("g", 10), ("g", None)]
    f = spark.createDataFrame([(n, i, at(a), at(b)) for n, i, a, b in flows], "file string, id int, a timestamp, b timestamp")
    p = spark.createDataFrame([(n, None if s is None else at(s)) for n, s in packets], "file string, at timestamp")
    got = {r.id: r.emitted for r in emission.emitted(f, p, "file", "a", "b", "at").collect()}
    # flow 2 is due at 125, and the packet of that very time lets it go; 4 is due at 420, 3 at 520; 1 at 1020 and 5 at 1080 stay to the end
    assert got == {2: 4, 4: 7, 3: 8, 1: 13, 5: 13, 6: 2, 7: 0}
    order = [r.id for r in emission.emitted(f, p, "file", "a", "b", "at").filter("file = 'f'").orderBy("emitted", "a", "id").collect()]
    assert order == [2, 4, 3, 1, 5]
    seen = halo.trailing_features(emission.emitted(f, p, "file", "a", "b", "at"), ["file"], ["emitted", "a", "id"], 2, {"s": F.col("id")}, {}, {})
    assert {r.id: r.s for r in seen.filter("file = 'f'").collect()} == {2: 0, 4: 2, 3: 6, 1: 7, 5: 4}


def test_emission_by_replay(spark):
    rnd = random.Random(3)
    packets = [(rnd.choice("ab"), rnd.randrange(4000)) for _ in range(500)]
    flows = [(rnd.choice("abc"), k, s := rnd.randrange(4000), s + rnd.randrange(900)) for k in range(120)]
    want = {}
    for file, k, a, b in flows:
        times = sorted(s for n, s in packets if n == file)
        want[k] = next((i for i, s in enumerate(times) if s >= min(a + 1800, b + 120)), len(times))
    f = spark.createDataFrame([(n, i, at(a), at(b)) for n, i, a, b in flows], "file string, id int, a timestamp, b timestamp").repartition(5)
    p = spark.createDataFrame([(n, at(s)) for n, s in packets], "file string, at timestamp").repartition(5)
    assert {r.id: r.emitted for r in emission.emitted(f, p, "file", "a", "b", "at").collect()} == want


ROWS = "row int, src string, dst string, ts timestamp, dur double, bytes double, label string"
PACKETS = "id int, src string, dst string, at timestamp, payload binary"
HOW = dict(row="row", tuple_cols=["src", "dst"], swaps=[("src", "dst")], ts="ts", csv_bytes="bytes", label="label")


def test_attempted_packets(spark):
    rows = [
        (1, "a", "b", at(100), 10.0, 5.0, "Web Attack - SQL Injection - Attempted"), (2, "a", "b", at(100), 10.0, 0.0, "Web Attack - SQL"), (3, "a", "b", None, None, 5.0, "Web Attack - XSS"),
        (4, "x", "y", at(0), 0.0, 5.0, "Web Attack - XSS"), (5, "c", "c", at(50), 0.0, 1.0, "Web Attack - Brute Force"), (6, "b", "a", at(500), None, 5.0, "Web Attack - SQL"),
    ]
    packets = [
        (1, "a", "b", at(97), b"early"), (2, "b", "a", at(113), b"x' OR 1"), (3, "a", "b", at(96.999), b"select * from"), (4, "a", "b", at(113.001), b"union select"), (5, "a", "b", at(100), b""), (6, "a", "b", at(101), None),
        (7, "c", "c", at(53), b"\xff pass=1"), (8, "a", "b", at(499), b"  "),
    ]
    out = P.attempted_packets(spark.createDataFrame(rows, ROWS), spark.createDataFrame(packets, PACKETS), duration="dur", at="at", packet="id", payload="payload", tolerance=3.0, **HOW)
    got = {r.row: (r.n_packets, r.payload_bytes, r.pcap_match_status, r.signature_decision, r.signature_hits) for r in out.collect()}
    assert got == {
        1: (4, 12, "matched", "recover", ["sql_quote_or"]), 2: (0, 0, "not_scanned_zero_csv_forward_payload", "keep_excluded", []),
        3: (7, 39, "matched", "manual_review", []), 4: (0, 0, "not_matched", "manual_review", []), 5: (1, 8, "matched", "recover", ["credential_field"]), 6: (1, 2, "matched", "keep_excluded", []),
    }
    assert out.columns[:7] == [c.split()[0] for c in ROWS.split(", ")]


@pytest.mark.parametrize("cap", [1, 7, 40, 65_536])
def test_cap_is_reached_by_the_last_payload(spark, cap):
    rnd = random.Random(cap)
    pairs = [(k % 3, rnd.randrange(50), k, rnd.choice((0, 0, 1, 3, 9))) for k in range(300)]
    got = sorted(r.id for r in P.capped_payloads(spark.createDataFrame(pairs, "row int, at int, id int, size bigint"), "row", ["at", "id"], "size", cap).collect())
    want = []
    for row in range(3):
        total = 0
        for _, _, k, size in sorted(p for p in pairs if p[0] == row and p[3]):
            if total < cap:
                want.append(k)
            total += size
    assert got == sorted(want)


def test_hot_window_is_dealt(spark):
    """One row with 300,000 packets in its window: no task of the final window holds more than its cap of them."""
    pairs = spark.range(300_000).select(F.lit(1).alias("row"), F.col("id").alias("at"), "id", F.lit(1).cast("bigint").alias("size"))
    assert P.capped_payloads(pairs, "row", ["at", "id"], "size", 1000).count() == 1000


def test_attempted_flows(spark):
    rows = [(1, "a", "b", at(100), 0.0, 5.0, "Web Attack - XSS"), (2, "b", "a", None, 0.0, 5.0, "Web Attack - SQL"), (3, "a", "b", at(100), 0.0, 0.0, "Web Attack - XSS"), (4, "a", "b", at(900), 0.0, 5.0, "Web Attack - XSS"), (5, "q", "r", at(1), 0.0, 5.0, "x")]
    flows = [(10, "b", "a", at(103), [b"<script>", None, b"\x00\x01"]), (11, "a", "b", at(100), [b"plain"]), (12, "a", "b", at(901), [None, b""])]
    out = P.attempted_flows(spark.createDataFrame(rows, ROWS), spark.createDataFrame(flows, "fid int, src string, dst string, fts timestamp, p array<binary>"), flow_ts="fts", flow_order="fid", payloads="p", tolerance=3.0, **HOW)
    got = {r.row: (r.matched_flow, r.delta_us, r.n_packets, r.payload_bytes, r.payload_nonzero, r.pcap_match_status, r.signature_decision) for r in out.collect()}
    assert got == {
        1: (10, 3_000_000, 2, 10, 0.9, "matched", "recover"), 2: (10, None, 2, 10, 0.9, "matched", "manual_review"), 3: (10, 3_000_000, 2, 10, 0.9, "matched", "keep_excluded"),
        4: (12, 1_000_000, 1, 0, 0.0, "matched", "keep_excluded"), 5: (None, None, 0, 0, 0.0, "not_matched", "manual_review"),
    }


def test_candidates_without_a_time(spark):
    """They take a tuple's first flow; how many it has is counted, and only two of them are joined."""
    c = spark.createDataFrame([(1, "a", "b", None), (2, "b", "a", None), (3, "p", "p", None), (4, "a", "c", None), (5, "z", "z", None)], "cid int, x string, y string, cts timestamp")
    f = spark.createDataFrame([(k, "a", "b", at(k)) for k in range(50)] + [(100, "b", "a", at(0)), (200, "p", "p", at(0)), (300, "c", "a", at(1))], "fid int, x string, y string, fts timestamp")
    for strict in (True, False):
        out = joins.match_flows(c, f, ["x", "y"], [("x", "y")], "cid", "cts", "fts", "fid", 3.0, strict=strict)
        got = {r.cid: (r.fid, r.reversed, r.n_matches, r.status) for r in out.collect()}
        two = "AMBIGUOUS_MATCH" if strict else "MATCHED"
        assert got == {1: (0, False, 51, two), 2: (100, False, 51, "MATCHED") if strict else (0, True, 51, "MATCHED"), 3: (200, False, 1, "MATCHED"), 4: (300, True, 1, "MATCHED")}


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("tolerance", [0.0, 1.0, 4.0])
def test_match_against_plain_python(spark, strict, tolerance):
    """Ties, equal times, both ends of the tolerance, palindromic tuples; against all pairs."""
    rnd = random.Random(int(tolerance))
    cands = [(k, rnd.choice("pq"), rnd.choice("pqr"), None if k % 9 == 0 else rnd.randrange(-30, 30) / 2) for k in range(120)]
    flows = [(k, rnd.choice("pqr"), rnd.choice("pq"), rnd.randrange(-40, 40) / 2) for k in range(150)]
    rnd.shuffle(flows)
    want = {}
    for k, x, y, s in cands:
        pairs = {}
        for f, fx, fy, t in flows:
            for back, (a, b) in ((False, (x, y)), (True, (y, x))):
                if (a, b) == (fx, fy) and (s is None or abs(s - t) <= tolerance) and f not in pairs:
                    pairs[f] = (back, 0 if s is None else round(abs(s - t) * 1e6), f)
        if pairs:
            line = sorted(pairs.values()) if strict else [pairs[min(pairs)], (None, None, None)]
            tie = len(line) > 1 and line[0][:2] == line[1][:2]
            want[k] = (line[0][2], line[0][0], None if s is None else line[0][1], len(pairs), "AMBIGUOUS_MATCH" if tie else "MATCHED")
    c = spark.createDataFrame([(k, x, y, None if s is None else at(s)) for k, x, y, s in cands], "cid int, x string, y string, cts timestamp")
    f = spark.createDataFrame([(k, x, y, at(t)) for k, x, y, t in flows], "fid int, x string, y string, fts timestamp").repartition(3)
    out = joins.match_flows(c, f, ["x", "y"], [("x", "y")], "cid", "cts", "fts", "fid", tolerance, strict=strict)
    assert {r.cid: (r.fid, r.reversed, r.delta_us, r.n_matches, r.status) for r in out.collect()} == want


def shuffled_records(spark, df):
    """How many rows df's stages write to shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def test_match_without_pairs(spark):
    """2,000 candidates and 2,000 flows of one tuple within the tolerance are four million pairs; few rows are shuffled."""
    c = spark.range(2000).select(F.col("id").alias("cid"), F.lit("a").alias("x"), F.lit("b").alias("y"), F.timestamp_micros(F.col("id")).alias("cts"))
    f = spark.range(2000).select(F.col("id").alias("fid"), F.lit("a").alias("x"), F.lit("b").alias("y"), F.timestamp_micros(F.col("id")).alias("fts"))
    out = joins.match_flows(c, f, ["x", "y"], [("x", "y")], "cid", "cts", "fts", "fid", 3600.0)
    assert shuffled_records(spark, out) < 100_000
    assert out.filter("n_matches = 2000 and fid = cid and delta_us = 0 and status = 'MATCHED'").count() == 2000


@pytest.mark.parametrize("cap", [5, 40, 65_536])
def test_attempted_packets_against_plain_python(spark, cap):
    """Packets and bytes of windows over several bands, some without an end or a time, against all pairs."""
    rnd = random.Random(cap)
    rows = [(k, rnd.choice("pq"), rnd.choice("pqr"), None if k % 9 == 0 else rnd.randrange(20_000), rnd.choice((None, 0.0, 50.5, 9000.0, -20.0)), float(k % 5)) for k in range(60)]
    packets = [(k, rnd.choice("pqr"), rnd.choice((None, "p", "q")), None if k % 30 == 0 else rnd.randrange(20_000), rnd.choice((None, b"", b"a" * rnd.randrange(1, 9)))) for k in range(400)]
    want = {}
    for k, x, y, s, length, size in rows:
        held = [(-1 if t is None else t, i, p or b"") for i, a, b, t, p in packets if (a, b) in ((x, y), (y, x)) and size and (s is None or t is not None and s - 3 <= t <= s + (length or 0) + 3)]
        total = 0
        for _, _, p in sorted(held):
            total += len(p) if total < cap else 0
        want[k] = (len(held), total)
    r = spark.createDataFrame([(k, x, y, None if s is None else at(s), n, z, "Web Attack - XSS") for k, x, y, s, n, z in rows], ROWS)
    p = spark.createDataFrame([(k, x, y, None if t is None else at(t), b) for k, x, y, t, b in packets], PACKETS).repartition(3)
    out = P.attempted_packets(r, p, duration="dur", at="at", packet="id", payload="payload", tolerance=3.0, cap=cap, **HOW)
    assert {x.row: (x.n_packets, x.payload_bytes) for x in out.collect()} == want


def test_attempted_packets_without_pairs(spark):
    """2,000 rows whose windows hold 2,000 packets each are four million pairs; few rows are shuffled."""
    r = spark.range(2000).select(F.col("id").cast("int").alias("row"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.timestamp_micros(F.col("id")).alias("ts"), F.lit(1.0).alias("dur"), F.lit(1.0).alias("bytes"), F.lit("x").alias("label"))
    p = spark.range(2000).select(F.col("id").cast("int").alias("id"), F.lit("b").alias("src"), F.lit("a").alias("dst"), F.timestamp_micros(F.col("id")).alias("at"), F.encode(F.lit("ab"), "UTF-8").alias("payload"))
    out = P.attempted_packets(r, p, duration="dur", at="at", packet="id", payload="payload", tolerance=3.0, cap=100, **HOW)
    assert shuffled_records(spark, out) < 100_000
    assert out.filter("n_packets = 2000 and payload_bytes = 100").count() == 2000
