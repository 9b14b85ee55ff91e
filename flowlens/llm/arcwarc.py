"""Legacy archive converter: ARC files, versions 1 and 2, to WARC.

ARC records are found by their version's header line and declared length. Each becomes a WARC record with an identifier
made from its place and content, the ARC date as WARC-Date, a type and SHA-256 digests; of records with equal payloads all
but the first become revisits. Files are written by Spark's text writer (a record a row, the records' own separators as
line ends) and read as binary files, so any file system that Spark knows will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import cut, need, new_path, ship, salted_join

# Fixed field lists of the ARC formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 100
_BATCH_BYTES = 8 << 20
_MARK = "#page_id="


def _as_text(values: list[bytes]) -> pa.Array:
    """A string column of bytes as they are; the text writer copies them unchanged."""
    return pa.array(values, pa.binary()).view(pa.string())


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_header(version: int, url: str, date: str, mime: str, length: int, status: str = "200", ip: str = "0.0.0.0") -> str:
    given = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": status, "Offset": "0", "Archive-length": str(length)}
    return " ".join(given.get(f, "-") for f in ARC_FIELDS[version])


def arc_start(version: int, date: str) -> bytes:
    """The version record that opens an ARC file, without the line end that closes it."""
    block = f"{version} 0 flowlens\n{' '.join(ARC_FIELDS[version])}\n"
    return (arc_header(version, "filedesc://flowlens.arc", date, "text/plain", len(block)) + "\n" + block).encode()


def _http(html: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html


def _url(url: str | None, page_id: int) -> str:
    """A URL without white space, with the page's id as its fragment."""
    plain = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:page")
    return f"{plain}{_MARK}{page_id}"




def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write pages as gzip-compressed ARC files below path, in folders version=1 and version=2 (by the parity of the id).

    Null bodies are empty, null URLs get a stand-in, white space in URLs is percent-encoded. A row is a record, so
    repeated rows give repeated records; a null id is written as "None".
    """
    need(pages, [id_col, url_col, body_col])
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col), F.col(body_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), _as_text([r[2] for r in rows])], ["version", "place", "value"]
            )

        yield out([(v, 0, arc_start(v, date)) for v in ARC_FIELDS])
        place = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for page_id, url, body in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in range(3)), strict=True):
                    content, version, place = _http((body or "").encode("utf-8")), 1 + (page_id or 0) % 2, place + 1
                    rows.append((version, place, arc_header(version, _url(url, page_id), date, "text/html", len(content)).encode() + b"\n" + content))
                yield out(rows)

    placed = rows.mapInArrow(run, "version int, place bigint, value string").sortWithinPartitions("version", "place")
    placed.drop("place").write.partitionBy("version").option("compression", "gzip").option("lineSep", "\n").text(path)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record but the first; the first names the version, whose field list reads the others.

    A record that is cut off, or a header line that does not fit the version, ends the file.
    """
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    first = file.readline().split()
    if not first or not first[0].startswith(b"filedesc:") or not first[-1].isdigit():
        return
    start = file.read(int(first[-1]))
    number = start.split(b" ", 1)[0]
    names = ARC_FIELDS.get(int(number) if number.isdigit() else 0)
    while names:
        line = file.readline()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        # A content type may hold blanks: the fields before it are counted from the left, those after it from the right.
        parts, after = line.decode("utf-8", "surrogateescape").split(), len(names) - 4
        if len(parts) < len(names) or not parts[-1].isdigit():
            return
        values = [*parts[:3], " ".join(parts[3 : len(parts) - after]), *parts[len(parts) - after :]]
        body = file.read(int(parts[-1]))
        if len(body) < int(parts[-1]):
            return
        yield dict(zip(names, values, strict=True)), body


def _iso(date: str) -> str:
    """The 14 digits of an ARC date (12 in old files) as WARC writes them."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_CONVERTED = "uri string, date string, ip string, kind string, content_type string, record_id string, payload_bytes bigint, payload_digest string, head_bytes int, block binary"


def _convert(fields: dict[str, str], content: bytes) -> tuple:
    """What WARC needs to know of one ARC record."""
    uri = fields["URL"]
    web = uri.split(":", 1)[0].lower() in ("http", "https") or content.startswith(b"HTTP/")
    cut_at = content.find(b"\r\n\r\n") + 4 if content.startswith(b"HTTP/") and b"\r\n\r\n" in content else 0
    digest = hashlib.sha256(memoryview(content)[cut_at:]).hexdigest()
    kind, content_type = ("response", "application/http; msgtype=response") if web and cut_at else ("resource", fields["Content-type"])
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {fields['Archive-date']} {digest}")
    return uri, _iso(fields["Archive-date"]), fields["IP-address"], kind, content_type, f"urn:uuid:{name}", len(content) - cut_at, digest, cut_at, content


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Records of ARC files as WARC sees them; without blocks the column block is null."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CONVERTED.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int32(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for file in batch.column(0):
                rows, size = [], 0
                for fields, content in arc_records(file.as_py()):
                    got = _convert(fields, content)
                    rows.append(got if blocks else (*got[:-1], None))
                    size += len(content) + 500
                    if size >= _BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _CONVERTED)


# --- WARC --------------------------------------------------------------------------------------------------------


def _warc(kind: str, record_id: str, date: str, content_type: str, block: bytes, more: list[tuple[str, object]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *more, ("Content-Type", content_type), ("Content-Length", len(block))]
    head = "".join(f"{a}: {b}\r\n" for a, b in lines)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Convert ARC files below arc_path to gzip-compressed WARC files below warc_path.

    Of records with equal payloads of least_bytes or more the one with the least (page id, URI) stays, the others become
    revisits that hold its identifier, date and URI and only their own HTTP header. Digests go through one narrow
    aggregation; payloads themselves are only shuffled if repeated digests are too many to broadcast, and then the records of
    one digest are dealt to many tasks.
    """
    ship(spark)
    narrow = read_arc(spark, arc_path, blocks=False).filter(F.col("payload_bytes") >= least_bytes)
    # The fragment orders pages by number; URIs without it come after those that have it.
    page = F.expr(f"try_cast(substring_index(uri, '{_MARK}', -1) as bigint)")
    order = F.struct(F.coalesce(page, F.lit(2**63 - 1)), "uri", "record_id", "date")
    firsts = narrow.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = cut(
        firsts.select("payload_digest", F.col("first.uri").alias("first_uri"), F.col("first.record_id").alias("first_id"), F.col("first.date").alias("first_date")),
        "firsts",
    )
    both = salted_join(read_arc(spark, arc_path), firsts, ["payload_digest"], ["uri", "record_id"], firsts.count(), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: flowlens\r\nformat: WARC File Format 1.1\r\n"
        first = _warc("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, warc_path)}", "2024-01-01T00:00:00Z", "application/warc-fields", info, [])
        yield pa.RecordBatch.from_arrays([_as_text([first])], ["value"])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    more = [("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"), ("X-Payload-Length", r["payload_bytes"])]
                    block, kind = r["block"], r["kind"]
                    if r["payload_bytes"] >= least_bytes and r["first_uri"] not in (None, r["uri"]):
                        kind, block = "revisit", block[: r["head_bytes"]]
                        more += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{r['first_id']}>"), ("WARC-Refers-To-Target-URI", r["first_uri"]), ("WARC-Refers-To-Date", r["first_date"])]
                    more.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
                    out.append(_warc(kind, r["record_id"], r["date"], r["content_type"], block, more))
                yield pa.RecordBatch.from_arrays([_as_text(out)], ["value"])

    both.mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc_path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record by its declared length."""
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue  # blank lines between records
        headers = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, file.read(int(headers.get("content-length", 0)))


_READ = "uri string, type string, date string, record_id string, payload_bytes bigint, payload_digest string, refers_to_uri string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files other than warcinfo; payload facts of full records are worked out anew, those of revisits are as declared."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _READ.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for h, block in warc_records(file.as_py()):
                    kind = h.get("warc-type", "")
                    if kind == "warcinfo":
                        continue
                    size, digest = int(h.get("x-payload-length", 0)), h.get("warc-payload-digest", "").removeprefix("sha256:")
                    if kind != "revisit":
                        at = block.find(b"\r\n\r\n") + 4 if h.get("content-type", "").startswith("application/http") else 0
                        size, digest = len(block) - at, hashlib.sha256(memoryview(block)[at:]).hexdigest()
                    rows.append((h.get("warc-target-uri"), kind, h.get("warc-date"), h.get("warc-record-id"), size, digest, h.get("warc-refers-to-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _READ)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) as ARC, convert to WARC, read the WARC files back: one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload. Rows that repeat a
    page_id are a record each; among equal payloads all those with the smallest page_id and URL are responses. Null ids
    are read back as null. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)

    def page(uri):
        return F.expr(f"try_cast(substring_index({uri}, '{_MARK}', -1) as bigint)")

    return read_warc(spark, warc).select(
        page("uri").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to_uri").alias("refers_to")
    )
