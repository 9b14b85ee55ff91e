"""Captures of both kinds, their projections, and the table sources and sinks."""

import struct

from pyspark.sql import functions as F

from flowlens.functions.scalars import epoch_seconds
from flowlens.plans.stores import capture_discovery
from flowlens.sources import captures as C
from flowlens.sources import tables as T
from flowlens.sources.stores import discovered


def ipv4(proto, body, src=(10, 0, 0, 1), dst=(8, 8, 4, 4), offset=0, tags=0, trailer=b""):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, offset, 64, proto, 0, bytes(src), bytes(dst))
    return b"\x02" * 12 + b"\x81\x00\x00\x05" * tags + b"\x08\x00" + head + body + trailer


TCP = struct.pack(">HHIIBBHHH", 40000, 80, 1, 2, 0x50, 0x18, 100, 0, 0) + b"GET / \xff"
UDP = struct.pack(">HHHH", 5353, 53, 12, 0) + b"abcd"
ICMP = b"\x08\x03\x00\x00rest"
FRAMES = [
    ipv4(6, TCP, trailer=b"\0\0\0"),
    ipv4(17, UDP, tags=2),
    ipv4(1, ICMP),
    ipv4(17, UDP, offset=5),
    b"\x02" * 12 + b"\x86\xdd" + b"x" * 60,
    ipv4(47, b"gre!"),
]


def classic(order, magic, ticks, frames=FRAMES, cut=0):
    out = magic + struct.pack(f"{order}HHiIII", 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames):
        out += struct.pack(f"{order}IIII", 1000 + k, ticks // 4, len(f), len(f)) + f
    return out[: len(out) - cut]


def section(order, resolution, frames=FRAMES, link=1):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1))
    option = struct.pack(f"{order}HHB3x", 9, 1, resolution) + struct.pack(f"{order}HH", 0, 0)
    out += block(1, struct.pack(f"{order}HHI", link, 0, 0) + option)
    ticks = 2 ** (resolution & 127) if resolution & 128 else 10**resolution
    for k, f in enumerate(frames):
        t = (1000 + k) * ticks + ticks // 4
        out += block(6, struct.pack(f"{order}IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_captures_of_every_kind(spark, tmp_path):
    files = {f"c{k}.pcap": classic(o, m, t) for k, (m, (o, t)) in enumerate(C.CLASSIC.items())}
    files |= {"n1.pcapng": section("<", 6), "n2.pcapng": section(">", 9), "n3.pcapng": section("<", 0x80 | 10)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in C.read_captures(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.seq, r.ts_us, bytes(r.frame)))
    want = [(k, (1000 + k) * 1_000_000 + 250_000, f) for k, f in enumerate(FRAMES)]
    assert {name: sorted(rows) for name, rows in got.items()} == dict.fromkeys(files, want)


def test_broken_captures(spark, tmp_path):
    (tmp_path / "short.pcap").write_bytes(classic("<", b"\xd4\xc3\xb2\xa1", 1_000_000, cut=3))
    (tmp_path / "short.pcapng").write_bytes(section("<", 6)[:-5])
    (tmp_path / "other.txt").write_bytes(b"not a capture")
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "wifi.pcapng").write_bytes(section("<", 6, link=105))
    rows = C.read_captures(spark, str(tmp_path)).groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).count().collect()
    assert {r.f: r["count"] for r in rows} == {"short.pcap": 5, "short.pcapng": 5}


def test_transport(spark):
    df = spark.createDataFrame([("f", k, k, bytearray(f)) for k, f in enumerate(FRAMES)], C.SCHEMA)
    got = {r.seq: r for r in C.transport(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    assert (got[0].src_ip, got[0].dst_ip, got[0].src_port, got[0].dst_port, bytes(got[0].payload)) == ("10.0.0.1", "8.8.4.4", 40000, 80, b"GET / \xff")
    assert (got[1].src_port, got[1].dst_port, bytes(got[1].payload)) == (5353, 53, b"abcd")
    assert (got[2].src_port, got[2].dst_port) == (8, 3)
    assert (got[3].src_port, got[3].dst_port, got[3].fragment) == (0, 0, 5)
    assert got[0].ip_size == 20 + len(TCP) and got[0].transport_size == len(TCP)
    flows = {r.seq: r for r in C.flow_tuples(df).collect()}
    assert sorted(flows) == [0, 1, 2] and flows[2].src_port == 0


def test_slices_read_back(spark, tmp_path):
    rows = [("f", k, 5_000_000 - k, bytearray(f)) for k, f in enumerate(FRAMES)]
    C.write_slices(spark.createDataFrame(rows, C.SCHEMA).coalesce(1), str(tmp_path / "s"))
    got = C.read_captures(spark, str(tmp_path / "s")).orderBy("ts_us").collect()
    assert [(r.ts_us, bytes(r.frame)) for r in got] == sorted((t, bytes(f)) for _, _, t, f in rows)


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Src IP, Attack_Type \n1.2.3.4,Bot\n5.6.7.8,\n".encode())
    df = T.read_labelled_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Src IP", "Attack_Type"] and T.label_column(df.columns) == "Attack_Type"
    got = df.select(T.first_present(df, ["nothing", "Attack_Type", "Src IP"]).alias("x")).collect()
    assert [r.x for r in got] == ["Bot", "5.6.7.8"]
    assert T.label_column(["a", "b"]) is None


def test_registries_and_reports(spark, tmp_path):
    d = tmp_path / "UCAP172.31.69.25-part1.pcap"
    d.write_bytes(b"abc")
    files = T.registry(spark, str(tmp_path))
    assert [(r.name, r.size, r.sha256[:8]) for r in files.collect()] == [(d.name, 3, "ba7816bf")]
    assert [r.ip for r in T.captures_by_ip(files).collect()] == ["172.31.69.25"]
    ids = spark.createDataFrame([(k,) for k in range(4)], "identity long")
    for _ in range(2):
        T.mark_done(ids.filter("identity < 2"), str(tmp_path / "done"))
    assert sorted(r.identity for r in T.not_done(ids, str(tmp_path / "done")).collect()) == [2, 3]
    names = spark.createDataFrame([("b.pcap2",), ("x_00003.pcap",), ("a.pcap",), ("b.pcap10",), ("x_00001.pcap",)], "n string")
    assert [r.n for r in names.orderBy(T.chunk_order(F.col("n"))).collect()] == ["x_00001.pcap", "x_00003.pcap", "b.pcap2", "b.pcap10", "a.pcap"]
    T.write_jsonl(spark.createDataFrame([(1, "x")], "b long, a string"), str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("*.json")) == '{"a":"x","b":1}\n'
    assert [tuple(r) for r in T.read_jsonl(spark, str(tmp_path / "j"), "a string, b long").collect()] == [("x", 1)]
    lines = T.markdown_rows(spark.createDataFrame([("a|b\nc", 1), (None, 2)], "x string, y int")).collect()
    assert [r.line for r in lines] == ["| a\\|b c | 1 |", "|  | 2 |"]


def test_chunks_past_five_digits(spark):
    """Chunk 100000 follows 99999; a file of exactly the largest size is used."""
    names = ["a_00002.pcap", "a_99999.pcap", "a_100000.pcap", "a_000000300001.pcap", "a_" + "9" * 40 + ".pcap"]
    files = spark.createDataFrame([(f"/r/{n}", 10 + k // 4) for k, n in enumerate(names)], "path string, size bigint").orderBy("size", F.desc("path"))
    got = sorted((r.place, r.path[3:], r.status) for r in discovered(files, 10).collect())
    assert got == [(k, n, "use" if k < 4 else "skipped_has_chunks") for k, n in enumerate(names)]


def test_exact_price_is_no_large_file(spark, tmp_path):
    rows = [(1, 0, 150000.0), (99_999, 0, 150000.01), (100_000, 0, 149999.5)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: (r.place, r.status) for r in capture_discovery(spark, str(tmp_path)).collect()}
    assert got == {1: (0, "use"), 99_999: (1, "skipped_has_chunks"), 100_000: (2, "use")}


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)], "id long, klass string")
    T.write_shards(df, str(tmp_path / "s"), "klass", "id", 8, 1)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.id for r in back.collect()) == list(range(40))
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 8


def test_small_exports(spark, tmp_path):
    report = spark.createDataFrame([("b", 2), ("a, c", 1)], "x string, n int")
    for _ in range(2):  # written over
        T.write_report(report, str(tmp_path / "report"))
    [part] = (tmp_path / "report").glob("part-*")
    assert sorted(part.read_text().splitlines()) == ['"a, c",1', "b,2", "x,n"]
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "id int, klass string")
    assert sorted(r.id for r in T.sample_export(df, "klass", ["id"], 2).collect()) == [0, 1, 2, 3]
    times = spark.createDataFrame([("2018-02-16 10:00:00.123456",), (None,)], "t string").select(epoch_seconds(F.col("t").cast("timestamp")).alias("s"))
    assert [r.s for r in times.collect()] == [1518775200.123456, None]


def test_mounted_captures_pass_as_streams(spark, tmp_path):
    """Whole contents are no rows where files are mounted; names with blanks and signs are opened; contents give the same."""
    packets = spark.range(10_000).select(F.lit("f").alias("file"), F.col("id").alias("seq"), F.col("id").alias("ts_us"), F.encode(F.lpad(F.col("id").cast("string"), 60, "x"), "UTF-8").alias("frame"))
    C.write_slices(packets.coalesce(1), str(tmp_path / "a b%20+"))
    read = C.read_captures(spark, str(tmp_path / "a b%20+"))
    assert "ReadSchema: struct<path:string>" in read._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in read.orderBy("seq").collect()]
    assert [(r[1], r[2]) for r in got] == [(k, k) for k in range(10_000)]
    whole = spark.read.format("binaryFile").load(str(tmp_path / "a b%20+")).select("path", "content").mapInArrow(C._unpacked, C.SCHEMA)
    assert [tuple(r) for r in whole.orderBy("seq").collect()] == got
