"""Packet captures as a Spark data source, and projections of their frames.

A capture file is one partition: its record boundaries can only be found from the start. Large captures are given as many
files, as capture tools rotate them. Everything after the frames is DataFrame expressions on the binary column.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, seq bigint, ts_us bigint, frame binary"
ETHERNET = 1
_BATCH, _BYTES = 4096, 8 << 20  # frames and bytes of a batch

# Fixed magic numbers: byte order and ticks a second of classic captures, and the block types of pcapng.
CLASSIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
SECTION, INTERFACE, ENHANCED = 0x0A0D0D0A, 1, 6
_ORDER_MARK = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}


def classic_frames(f: io.BufferedIOBase, order: str, ticks: int) -> Iterator[tuple[int, bytes]]:
    """(microseconds, frame) after the magic number; a short record ends the file without an error."""
    f.read(20)
    while len(head := f.read(16)) == 16:
        sec, frac, kept, _ = struct.unpack(f"{order}IIII", head)
        frame = f.read(kept)
        if len(frame) < kept:
            return
        yield sec * 1_000_000 + frac * 1_000_000 // ticks, frame


def _ticks(options: bytes, order: str) -> int:
    """Ticks a second from option 9 of an interface: a power of ten, or of two if the top bit is set."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{order}HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            v = options[at + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + size + (-size % 4)
    return 1_000_000


def section_frames(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    """(microseconds, frame) of the Ethernet interfaces of a pcapng file, from its first byte; a short block ends it."""
    order, interfaces = "<", []
    while len(head := f.read(8)) == 8:
        if head[:4] == SECTION.to_bytes(4, "big"):
            mark = f.read(4)
            if mark not in _ORDER_MARK:
                return
            order, interfaces = _ORDER_MARK[mark], []
            size = struct.unpack(f"{order}I", head[4:])[0]
            if size < 16 or len(f.read(size - 12)) < size - 12:
                return
            continue
        kind, size = struct.unpack(f"{order}II", head)
        body = f.read(max(size - 8, 0))
        if size < 12 or len(body) < size - 8:
            return
        body = body[:-4]
        if kind == INTERFACE and len(body) >= 8:
            interfaces.append((struct.unpack_from(f"{order}H", body)[0], _ticks(body[8:], order)))
        elif kind == ENHANCED and len(body) >= 20:
            i, high, low, kept, _ = struct.unpack_from(f"{order}IIIII", body)
            if i < len(interfaces) and interfaces[i][0] == ETHERNET and len(body) >= 20 + kept:
                yield ((high << 32) | low) * 1_000_000 // interfaces[i][1], body[20 : 20 + kept]


def frames(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    """Frames of a capture of either kind, told by its first four bytes; other files have none."""
    magic = f.read(4)
    if magic in CLASSIC:
        yield from classic_frames(f, *CLASSIC[magic])
    elif magic == SECTION.to_bytes(4, "big"):
        f.seek(0)
        yield from section_frames(f)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of files given by path and content, or by path alone; then the file passes as a stream."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["file", "seq", "ts_us", "frame"]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for at, file in enumerate(batch.column(0).to_pylist()):
            content = io.BytesIO(batch.column(1)[at].as_buffer()) if batch.num_columns > 1 else open("/" + file.removeprefix("file:").lstrip("/"), "rb")
            with content as f:
                rows, size = [], 0
                for seq, (ts, frame) in enumerate(frames(f)):
                    rows.append((file, seq, ts, frame))
                    size += len(frame)
                    if len(rows) == _BATCH or size >= _BYTES:
                        yield block(rows)
                        rows, size = [], 0
                if rows:
                    yield block(rows)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, ts_us, frame) of the captures at path (a file, folder or glob in any store that Spark reads).

    Files of another kind and empty files give no rows; truncated files give the records before the break. Files of a
    mounted file system (file:) are opened by their task and pass as streams, so their size doesn't matter; of other stores
    a file is one row with its whole content.
    """
    files = spark.read.format("binaryFile").load(path)
    mounted = all(name.startswith("file:") for name in files.inputFiles()[:1])
    return files.select("path", *([] if mounted else ["content"])).mapInArrow(_unpacked, SCHEMA)


# --- frames to columns -------------------------------------------------------------------------------------------


def unsigned(b: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of size bytes (4 at most), from offset at (0-based) of a binary column; null beyond its end."""
    start = F.lit(at) if isinstance(at, int) else at
    part = F.hex(F.substring(b, start + 1, F.lit(size)))
    return F.when(F.length(b) >= start + size, F.conv(part, 16, 10).cast("bigint"))


def dotted(b: Column, at: Column) -> Column:
    return F.concat_ws(".", *[unsigned(b, at + k, 1).cast("string") for k in range(4)])


def transport(packets: DataFrame, most_tags: int = 2) -> DataFrame:
    """packets with src_ip, dst_ip, protocol, src_port, dst_port, fragment, ip_size, transport_size, tcp_flags and payload.

    Only IPv4 frames stay; up to most_tags VLAN tags are stepped over. TCP and UDP have ports, ICMP has its type and
    code in their place, other protocols have 0. fragment is the fragment offset; later fragments have no ports.
    """
    frame, tag = F.col("frame"), F.lit(0)
    for _ in range(most_tags):
        tag = tag + F.when(unsigned(frame, 12 + tag, 2).isin(0x8100, 0x88A8, 0x9100), 4).otherwise(0)
    p = packets.withColumn("_ip", 14 + tag).filter(unsigned(frame, F.col("_ip") - 2, 2) == 0x0800)
    p = p.filter(F.shiftright(unsigned(frame, F.col("_ip"), 1), 4) == 4)
    ip = F.col("_ip")
    p = p.withColumns(
        {
            "_head": unsigned(frame, ip, 1).bitwiseAND(F.lit(15)) * 4,
            "ip_size": unsigned(frame, ip + 2, 2),
            "fragment": unsigned(frame, ip + 6, 2).bitwiseAND(F.lit(0x1FFF)),
            "protocol": unsigned(frame, ip + 9, 1).cast("int"),
            "src_ip": dotted(frame, ip + 12),
            "dst_ip": dotted(frame, ip + 16),
        }
    ).filter((F.col("_head") >= 20) & (F.length("frame") >= ip + F.col("_head")))
    top = (ip + F.col("_head")).cast("int")
    first, ports, icmp = F.col("fragment") == 0, F.col("protocol").isin(6, 17), F.col("protocol") == 1

    def port(k: int) -> Column:
        got = F.when(first & ports, unsigned(frame, top + 2 * k, 2)).when(first & icmp, unsigned(frame, top + k, 1))
        return F.coalesce(got, F.lit(0)).cast("int")

    tcp_head = F.shiftright(unsigned(frame, top + 12, 1), 4) * 4
    skip = F.when(F.col("protocol") == 6, tcp_head).when(F.col("protocol") == 17, 8).otherwise(0)
    skip = F.when(first, F.coalesce(skip, F.lit(0))).otherwise(0).cast("int")
    end = F.least(F.length("frame"), ip + F.col("ip_size")).cast("int")
    return p.withColumns(
        {
            "src_port": port(0),
            "dst_port": port(1),
            "tcp_flags": F.when(first & (F.col("protocol") == 6), F.coalesce(unsigned(frame, top + 13, 1), F.lit(0))).otherwise(0).cast("int"),
            "transport_size": F.greatest(end - top, F.lit(0)).cast("bigint"),
            "payload": F.substring(frame, top + skip + 1, F.greatest(end - top - skip, F.lit(0))),
        }
    ).drop("_ip", "_head")


def flow_tuples(packets: DataFrame) -> DataFrame:
    """The view that flows are keyed by: TCP, UDP and ICMP, no later fragments, ICMP without ports."""
    icmp = F.col("protocol") == 1
    return transport(packets).filter(F.col("protocol").isin(1, 6, 17) & (F.col("fragment") == 0)).withColumns(
        {c: F.when(icmp, 0).otherwise(F.col(c)) for c in ("src_port", "dst_port")}
    )


def section_block(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def write_slices(packets: DataFrame, path: str) -> None:
    """Packets as pcapng captures with microseconds, one file a partition, in order of ts_us within a file.

    A block a row: blocks of less than 16 MiB end with a zero byte, which is what the text writer ends its lines with.
    """
    order = packets.sortWithinPartitions("ts_us", "file", "seq").select("ts_us", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = section_block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + section_block(INTERFACE, struct.pack("<HHI", ETHERNET, 0, 0))
        for batch in batches:
            out = []
            for ts, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts = struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame))
                out.append((head + section_block(ENHANCED, facts + frame))[:-1])
                head = b""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], ["value"])

    order.mapInArrow(run, "value string").write.option("lineSep", "\0").text(path)
