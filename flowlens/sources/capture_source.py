"""Captures as a Spark data source: large files read in byte ranges, both kinds of files written.

    spark.dataSource.register(CaptureSource)
    spark.read.format("flowlens_capture").option("rangeBytes", 64 << 20).load(folder)
    packets.write.format("flowlens_capture").option("kind", "pcap").mode("append").save(folder)

Paths are local ones or file: URIs of a file system that the driver and all executors mount, since tasks open files at
offsets; for other stores captures.read_captures reads files whole.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from flowlens.operators.ranks import ranked
from flowlens.sources.captures import CLASSIC, ENHANCED, ETHERNET, INTERFACE, SECTION, section_block, section_frames

SCHEMA = "file string, offset bigint, ts_us bigint, frame binary"
_ROWS, _BYTES = 4096, 8 << 20
#: Headers in sequence that must be sound for a place to count as a record's beginning; the largest frame; seconds that the
#: times of a capture lie apart at most.
CHAIN, LARGEST, SPAN = 32, 1 << 20, 366 * 86_400
#: How far before a cut the walk to it begins.
LOOKBACK = 2 * LARGEST


def local_path(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if rest and scheme == "file":
        return "/" + rest.lstrip("/")
    if rest.startswith("/"):
        raise ValueError(f"{path}: ranges are read from mounted file systems only; use captures.read_captures")
    return path


@dataclass(frozen=True)
class Classic:
    """What the head of a classic capture says: byte order, ticks a second, and the second of its first record."""

    order: str
    ticks: int
    first: int
    size: int

    def header(self, data: bytes, at: int = 0) -> tuple[int, int, int] | None:
        """(second, ticks, frame bytes) of a sound record header; None if it cannot be one."""
        sec, frac, kept, full = struct.unpack_from(f"{self.order}IIII", data, at)
        return (sec, frac, kept) if frac < self.ticks and kept <= full <= LARGEST and abs(sec - self.first) <= SPAN else None


def classic_head(path: str) -> Classic | None:
    """None for files that are no classic captures or hold no record."""
    with open(path, "rb") as f:
        head = f.read(40)
    if len(head) < 40 or head[:4] not in CLASSIC:
        return None
    order, ticks = CLASSIC[head[:4]]
    return Classic(order, ticks, struct.unpack_from(f"{order}I", head, 24)[0], os.path.getsize(path))


def is_record(f, at: int, head: Classic) -> bool:
    """Whether CHAIN sound headers follow each other from there, or all up to the file's end."""
    for _ in range(CHAIN):
        if at + 16 > head.size:
            return True  # the end, or a short record
        f.seek(at)
        got = head.header(f.read(16))
        if got is None:
            return False
        at += 16 + got[2]
    return True


def first_record(f, at: int, head: Classic) -> int:
    """The offset of the first record that begins there or later; the file's size if none does."""
    if at <= 24:
        return 24
    at = min(at, head.size)
    while at + 16 <= head.size:
        f.seek(at)
        window = f.read(1 << 16)
        for i in range(len(window) - 15):
            if head.header(window, i) is not None and is_record(f, at + i, head):
                return at + i
        at += max(len(window) - 15, 1)
    return head.size


def synced(f, at: int, head: Classic) -> int:
    """The offset of the first record that begins at that place or later, reached over the headers before it.

    What looks like a record within a frame, as in a capture of captures, leads to that frame's end or breaks off; either
    way the walk is on the file's own records once it has left the frame, and frames are shorter than the way walked.
    """
    place = first_record(f, max(at - LOOKBACK, 24), head)
    while place < at and place + 16 <= head.size:
        f.seek(place)
        got = head.header(f.read(16))
        place = first_record(f, place + 1, head) if got is None else place + 16 + got[2]
    return place if place + 16 <= head.size else head.size


def range_records(path: str, start: int, end: int, head: Classic) -> Iterator[tuple[int, int, bytes]]:
    """(offset, microseconds, frame) of the records that begin in the range; a short record ends the file.

    At its end the range looks for the next record as the range after it does. Should they not agree, that is an error:
    no record is lost or read twice without a word.
    """
    with open(path, "rb") as f:
        at = synced(f, start, head)
        f.seek(at)
        while at < end and at + 16 <= head.size:
            raw = f.read(16)
            sec, frac, kept, _ = struct.unpack(f"{head.order}IIII", raw)
            frame = f.read(kept)
            if len(frame) < kept:
                return
            yield at, sec * 1_000_000 + frac * 1_000_000 // head.ticks, frame
            at += 16 + kept
        if end < head.size and synced(f, end, head) != (at if at + 16 <= head.size else head.size):
            raise ValueError(f"{path}: no sure record boundary at {end}; read it with another rangeBytes")


class CapturePart(InputPartition):
    def __init__(self, path: str, start: int, end: int, head: Classic | None) -> None:
        self.path, self.start, self.end, self.head = path, start, end, head


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = local_path(path), range_bytes

    def partitions(self) -> list[CapturePart]:
        """Ranges of classic captures; a pcapng file is one part, as what its blocks mean depends on those before."""
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(top, n) for top, _, names in os.walk(self.path) for n in names if not n.startswith((".", "_")))
        parts = []
        for path in files:
            head = classic_head(path)
            if head is None:
                parts.append(CapturePart(path, 0, 0, None))
            else:
                parts += [CapturePart(path, at, min(at + self.range_bytes, head.size), head) for at in range(0, head.size, self.range_bytes)]
        return parts or [CapturePart("", 0, 0, None)]

    def read(self, part: CapturePart) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for at, ts, frame in self._records(part):
            rows.append((part.path, at, ts, frame))
            size += len(frame)
            if len(rows) == _ROWS or size >= _BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _records(part: CapturePart) -> Iterator[tuple[int, int, bytes]]:
        if part.head is not None:
            yield from range_records(part.path, part.start, part.end, part.head)
        elif part.path:
            with open(part.path, "rb") as f:
                if f.read(4) == SECTION.to_bytes(4, "big"):
                    f.seek(0)
                    for ts, frame in section_frames(f):
                        yield f.tell(), ts, frame  # the end of the block: it rises as the beginning does


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int


class CaptureWriter(DataSourceArrowWriter):
    """One file a task, first under a hidden name: a commit gives all of them their names, an abort removes them."""

    def __init__(self, path: str, kind: str, overwrite: bool, columns: list[str]) -> None:
        if kind not in ("pcap", "pcapng"):
            raise ValueError("kind is pcap or pcapng")
        if missing := {"ts_us", "frame"} - set(columns):
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.path, self.kind, self.overwrite, self.job = local_path(path), kind, overwrite, uuid.uuid4().hex
        self.hidden = os.path.join(self.path, f".job-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        name, n = f"{uuid.uuid4().hex}.{self.kind}", 0
        with open(os.path.join(self.hidden, name), "wb") as f:
            f.write(_file_head(self.kind))
            for batch in iterator:
                for ts, frame in zip(batch.column("ts_us").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                    f.write(_record(self.kind, ts, frame or b""))
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.path):
                if not name.startswith("."):
                    full = os.path.join(self.path, name)
                    shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)
        for m in messages:
            if m is not None and m.name and m.records:
                os.replace(os.path.join(self.hidden, m.name), os.path.join(self.path, f"part-{m.name}"))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)  # files of tasks that ran twice are there too


def _file_head(kind: str) -> bytes:
    if kind == "pcap":
        return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, ETHERNET)
    return section_block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + section_block(INTERFACE, struct.pack("<HHI", ETHERNET, 0, 0))


def _record(kind: str, ts_us: int, frame: bytes) -> bytes:
    if kind == "pcap":
        return struct.pack("<IIII", *divmod(ts_us, 1_000_000), len(frame), len(frame)) + frame
    return section_block(ENHANCED, struct.pack("<IIIII", 0, ts_us >> 32, ts_us & 0xFFFFFFFF, len(frame), len(frame)) + frame)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flowlens_capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        size = int(self.options.get("rangeBytes", 128 << 20))
        if size < 1:
            raise ValueError("rangeBytes is positive")
        return CaptureReader(self.options["path"], size)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], self.options.get("kind", "pcap"), overwrite, schema.names)


def micros_of_seconds(seconds) -> F.Column:
    """Whole microseconds of seconds with a fraction, half to even; a fraction that rounds up to a second is carried."""
    return F.bround(seconds * 1_000_000).cast("bigint")


def read_ranges(spark: SparkSession, path: str, range_bytes: int = 128 << 20) -> DataFrame:
    """(file, seq, ts_us, frame) of the captures at path, a large classic one over many tasks.

    seq is a record's number in its file, ranked by offsets over the ranges. Files of another kind and empty files give no
    rows; a truncated file gives the records before the break.
    """
    spark.dataSource.register(CaptureSource)
    found = spark.read.format("flowlens_capture").option("rangeBytes", range_bytes).load(path)
    return ranked(found, ["file"], ["offset"], "seq").select("file", (F.col("seq") - 1).alias("seq"), "ts_us", "frame")


def write_captures(packets: DataFrame, path: str, kind: str = "pcap", mode: str = "append") -> None:
    """Packets (file, seq, ts_us, frame) as capture files with microseconds, one a partition, in order of time in a file."""
    packets.sparkSession.dataSource.register(CaptureSource)
    os.makedirs(local_path(path), exist_ok=True)
    ordered = packets.sortWithinPartitions("ts_us", "file", "seq").select("ts_us", "frame")
    ordered.write.format("flowlens_capture").option("kind", kind).mode(mode).save(path)
