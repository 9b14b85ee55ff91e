"""Captures read in byte ranges at every cut, and both kinds written with a commit."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowlens.sources import capture_source as S
from flowlens.sources import captures as C
from tests.test_sources import FRAMES, classic, section


def records(path, step):
    head = S.classic_head(path)
    return [r for at in range(0, head.size, step) for r in S.range_records(path, at, min(at + step, head.size), head)]


@pytest.mark.parametrize("magic", list(C.CLASSIC))
def test_no_record_twice_or_lost_at_any_cut(tmp_path, magic):
    order, ticks = C.CLASSIC[magic]
    rnd = random.Random(ticks)
    # Frames of zeros, of other records' bytes, of nothing, and a whole capture within a frame
    inner = classic(order, magic, ticks)
    frames = [bytes(40), inner, b"", *FRAMES, rnd.randbytes(300), struct.pack(f"{order}IIII", 1003, 5, 60, 60) * 3, bytes(7)] + [rnd.randbytes(rnd.randrange(90)) for _ in range(60)]
    path = str(tmp_path / "one.pcap")
    data = classic(order, magic, ticks, frames)
    open(path, "wb").write(data)
    whole = [(ts, f) for ts, f in C.frames(open(path, "rb"))]
    assert len(whole) == len(frames)
    for step in (len(data), 1000, 333, 97, 24, 16, 7):
        got = records(path, step)
        assert [(ts, f) for _, ts, f in got] == whole, step
    for cut in range(25, len(data), 3):
        head = S.classic_head(path)
        got = [*S.range_records(path, 0, cut, head), *S.range_records(path, cut, head.size, head)]
        assert [f for *_, f in got] == frames, cut


def test_ambiguous_cut_is_an_error(tmp_path, monkeypatch):
    """A frame with a sound chain of records at the cut and no way walked to it: refused, not read wrong."""
    monkeypatch.setattr(S, "CHAIN", 3)
    monkeypatch.setattr(S, "LOOKBACK", 0)
    inner = b"".join(struct.pack("<IIII", 1000, 1, 4, 4) + b"data" for _ in range(50))
    path = str(tmp_path / "nested.pcap")
    open(path, "wb").write(classic("<", b"\xd4\xc3\xb2\xa1", 1_000_000, [b"before", inner, b"after"]))
    head = S.classic_head(path)
    with pytest.raises(ValueError, match="boundary"):
        list(S.range_records(path, 0, 300, head))
    assert len(list(S.range_records(path, 0, head.size, head))) == 3
    monkeypatch.setattr(S, "LOOKBACK", 1000)
    assert [f for *_, f in S.range_records(path, 0, 300, head)] == [b"before", inner] and [f for *_, f in S.range_records(path, 300, head.size, head)] == [b"after"]


def test_truncated_files(tmp_path):
    data = classic("<", b"\xd4\xc3\xb2\xa1", 1_000_000, FRAMES * 5)
    path = str(tmp_path / "short.pcap")
    for cut in (1, 5, 17, 40, 80):
        open(path, "wb").write(data[: len(data) - cut])
        whole = list(C.frames(open(path, "rb")))
        for step in (100, 61):
            assert [(ts, f) for _, ts, f in records(path, step)] == whole, (cut, step)
    for odd in (b"", b"\xd4\xc3\xb2\xa1", b"text file", data[:24], data[:39]):
        open(path, "wb").write(odd)
        assert S.classic_head(path) is None


def test_read_and_write_both_kinds(spark, tmp_path):
    rnd = random.Random(1)
    source = tmp_path / "in"
    source.mkdir()
    frames = [rnd.randbytes(rnd.randrange(1, 400)) for _ in range(700)]
    (source / "a.pcap").write_bytes(classic(">", b"\xa1\xb2\x3c\x4d", 1_000_000_000, frames))
    (source / "b.pcapng").write_bytes(section("<", 6, frames[:50]))
    (source / "c.txt").write_bytes(b"no capture")
    df = S.read_ranges(spark, str(source), 5000)
    rows = sorted((os.path.basename(r.file), r.seq, r.ts_us, bytes(r.frame)) for r in df.collect())
    assert rows == sorted([("a.pcap", k, (1000 + k) * 1_000_000 + 250_000, f) for k, f in enumerate(frames)] + [("b.pcapng", k, (1000 + k) * 1_000_000 + 250_000, f) for k, f in enumerate(frames[:50])])
    scan = spark.read.format("flowlens_capture").option("rangeBytes", 5000).load(f"file://{source}")
    assert scan.rdd.getNumPartitions() > 25
    for kind in ("pcap", "pcapng"):
        out = tmp_path / kind
        S.write_captures(df.repartition(3), str(out), kind)
        names = os.listdir(out)
        assert len(names) == 3 and all(n.startswith("part-") and n.endswith("." + kind) for n in names)
        back = C.read_captures(spark, str(out))  # the reader of whole files reads them too
        assert sorted((r.ts_us, bytes(r.frame)) for r in back.collect()) == sorted((ts, f) for _, _, ts, f in rows)
        S.write_captures(df.filter("seq < 10").coalesce(1), str(out), kind, "overwrite")
        assert len(os.listdir(out)) == 1 and S.read_ranges(spark, str(out)).count() == 20


def test_failed_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    bad = spark.range(40).select((F.col("id")).alias("seq"), F.lit("f").alias("file"), (F.col("id") * 10**15 - 10**15).alias("ts_us"), F.encode(F.lit("x"), "UTF-8").alias("frame"))
    with pytest.raises(Exception):  # noqa: B017  seconds before 1970 and beyond 32 bits have no place in a classic capture
        S.write_captures(bad, str(out))
    assert os.listdir(out) == []
    with pytest.raises(Exception, match="kind"):
        S.write_captures(bad, str(out), "cap")


def test_rounding_is_carried(spark):
    [r] = spark.range(1).select(S.micros_of_seconds(F.lit(1.9999999)).alias("a"), S.micros_of_seconds(F.lit(1518774000.123456)).alias("b")).collect()
    assert (r.a, r.b) == (2_000_000, 1518774000123456)


def test_remote_paths_are_refused():
    assert S.local_path("file:///a/b") == "/a/b" and S.local_path("/a:b/c") == "/a:b/c"
    with pytest.raises(ValueError, match="mounted"):
        S.local_path("hdfs://host/a")
