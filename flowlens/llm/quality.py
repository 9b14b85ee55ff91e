"""Quality rules on whole texts: word rules and zstandard compression bands.

The ratio of raw to compressed size is taken over the whole document, over each fixed chunk and over each small piece.
Text that compresses too well is repetitive, text that hardly compresses is noise; what is too much depends on the length,
since short texts give the compressor little to work with.

The least ratios are what noise of that length compresses to at most: base64 in words of four characters, at the longest
text of the band (random printable characters and longer words compress less). Pieces find noise between prose, from about
one piece on. Hexadecimal noise compresses like text and is not found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import need, ship


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio by size: (bytes from, least, most) for documents, one pair for chunks, the least for pieces."""

    level: int = 3
    chunk: int = 4096
    document: tuple[tuple[int, float, float], ...] = (
        (0, 1.12, 3.0),
        (200, 1.19, 3.0),
        (256, 1.27, 3.5),
        (512, 1.36, 3.5),
        (1024, 1.4, 4.0),
        (2048, 1.42, 4.0),
        (4096, 1.44, 5.0),
        (32768, 1.5, 6.0),
    )
    chunks: tuple[float, float] = (1.43, 5.0)
    piece: int = 512
    piece_least: float = 1.28
    share: float = 0.5  # of the chunks that may be too repetitive
    noise_share: float = 0.25  # of the chunks, and of the pieces, that may be noise
    min_words: int = 50
    max_repeat_percent: int = 50


#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, most_chunk_ratio double, reason string"
)
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)
_NOT_STARTS = bytes(range(0x80, 0xC0))  # bytes inside a character


def word_facts(data: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, words in repeated windows of three."""
    words = data.split()  # at the six ASCII white-space bytes
    n = len(words)
    chars = len(b"".join(words).translate(None, _NOT_STARTS))
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        count, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _verdict(bands: Bands, n: int, repeated: int, ratio: float, size: int, chunk_ratios: list[float]) -> str:
    if n < bands.min_words:
        return "few_words"
    if 100 * repeated > bands.max_repeat_percent * n:
        return "repeated_words"
    _, least, most = next(b for b in reversed(bands.document) if size >= b[0])
    if ratio > most:
        return "repetitive"
    if ratio < least:
        return "incompressible"
    low, high = bands.chunks
    if sum(r > high for r in chunk_ratios) > bands.share * len(chunk_ratios):
        return "repetitive_chunks"
    if sum(r < low for r in chunk_ratios) > bands.noise_share * len(chunk_ratios):
        return "incompressible_chunks"
    return ""


def _windows(data: bytes, size: int) -> list[bytes]:
    """Whole windows of data longer than one: a short rest would look like noise, so the last one ends with the data."""
    if len(data) <= size:
        return []
    starts = [*range(0, len(data) - size + 1, size)]
    return [data[at : at + size] for at in (starts if len(data) % size == 0 else [*starts, len(data) - size])]


def _judge(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                n, chars, symbols, lines, repeated = word_facts(data)
                ratio = len(data) / len(compress(data)) if data else 1.0
                ratios = [len(p) / len(compress(p)) for p in _windows(data, bands.chunk)]
                why = _verdict(bands, n, repeated, ratio, len(data), ratios)
                if not why:
                    pieces = _windows(data, bands.piece)
                    if sum(len(p) < bands.piece_least * len(compress(p)) for p in pieces) > bands.noise_share * len(pieces):
                        why = "incompressible_pieces"
                base = why in ("few_words", "repeated_words")
                rows.append((doc_id, n, chars, symbols, lines, repeated, base, not why, ratio, min(ratios, default=None), max(ratios, default=None), why or None))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: word facts, compression ratios, base_failed, kept and the reason of a rejection.

    Null text counts as empty: no words, so it fails for few words. Texts are read whole. Rows are independent, so
    repeated rows and ids repeat their results; columns besides the two named are ignored. An empty table gives no rows.
    """
    need(docs, [id_col, text_col])
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_judge(bands), _SCHEMA)


def passing(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with their columns and without a shuffle.

    Null and empty texts have too few words and go. Rows are judged alone and whole, so repeated rows stay or go
    together; columns pass through, whatever their names, and an empty table stays empty.
    """
    need(docs, [text_col])
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = pa.array(range(batch.num_rows), pa.int64())
            ask = pa.RecordBatch.from_arrays([index, batch.column(at)], ["doc_id", "text"])
            for verdict in _judge(bands)(iter([ask])):
                yield batch.filter(verdict.column("kept"))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # Python batches need plain names
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
