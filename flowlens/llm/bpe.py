"""Byte-level BPE with forced-boundary splitting.

A byte pair that stands inside no vocabulary token is never merged across. Such a pair in a text is a certain cut: the
fragments on both sides are encoded independently and their ids concatenated. Cuts are only taken where the
pre-tokenizer's pattern cannot see over them either: not after white space (its look-ahead), not before an apostrophe
(contractions), and never inside a character. Fragments are mostly single words, so each task keeps the codes of those
it has met.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import need, ship

_APOSTROPHE = 0x27
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
_MOST_KEPT, _LONGEST_KEPT = 400_000, 64
_loaded: dict[tuple, ForcedBoundaryBpe] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder for one vocabulary; ranks_path and pattern describe the same vocabulary for the fragment encoder."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {
            i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special
        } | {i: t.encode() for t, i in self.special.items()}
        inside = np.zeros(65536, dtype=bool)
        for t in self.bytes_of.values():
            if len(t) > 1:
                raw = np.frombuffer(t, dtype=np.uint8).astype(np.uint16)
                inside[raw[:-1] * 256 + raw[1:]] = True
        cut = ~inside.reshape(256, 256)
        cut[:0x21, :] = False  # not after white space or control characters
        cut[0x7F, :] = False
        cut[:, _APOSTROPHE] = False
        cut[:, 0x80:0xC0] = False  # not inside a character
        self.cuts = np.ascontiguousarray(cut.reshape(-1))
        ascii_only = cut.copy()
        ascii_only[0x80:, :] = False  # where a text holds white space beyond ASCII
        self.plain_cuts = np.ascontiguousarray(ascii_only.reshape(-1))
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("fragments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.markers = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode("utf-8")
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint16)
        if len(raw) < 2:
            return [data] if data else []
        table = self.plain_cuts if _OTHER_SPACE.search(text) else self.cuts
        at = (np.flatnonzero(table[raw[:-1] * 256 + raw[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)], strict=True)]

    def _code(self, fragment: bytes) -> tuple[int, bytes, bytes]:
        ids = self.encoding.encode_ordinary(fragment.decode("utf-8"))
        got = (len(ids), ",".join(map(str, ids)).encode(), b"".join([self.bytes_of[i] for i in ids]))
        if len(fragment) <= _LONGEST_KEPT:
            if len(self.known) >= _MOST_KEPT:
                self.known.clear()
            self.known[fragment] = got
        return got

    def code(self, text: str) -> tuple[int, bytes, bytes]:
        """Token count, decimal ids joined by commas, and the bytes that the ids decode to."""
        parts: list[tuple[int, bytes, bytes]] = []
        at = 0
        for m in self.markers.finditer(text) if "<" in text or not self.special else ():
            parts += self._segment(text[at : m.start()])
            parts.append((1, str(self.special[m.group()]).encode(), m.group().encode()))
            at = m.end()
        parts += self._segment(text[at:] if at else text)
        return sum(p[0] for p in parts), b",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def _segment(self, text: str) -> list[tuple[int, bytes, bytes]]:
        known, code = self.known.get, self._code
        return [known(f) or code(f) for f in self.fragments(text)]

    def ids(self, text: str) -> list[int]:
        listed = self.code(text)[1]
        return [int(x) for x in listed.split(b",")] if listed else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def encoder(json_path: str, ranks_path: str, pattern: str) -> ForcedBoundaryBpe:
    key = (json_path, ranks_path, pattern)
    if key not in _loaded:
        _loaded[key] = ForcedBoundaryBpe(*key)
    return _loaded[key]


def _digests(paths: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(*paths)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1):
                count, listed, decoded = bpe.code(text.as_py() or "")
                n.append(count)
                ids.append(hashlib.sha256(listed).hexdigest())
                back.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _encode(paths: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.ids(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, at any length; null and empty texts give an empty array.

    Rows are independent, so repeated rows and ids repeat their results; other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    need(docs, [id_col, text_col])
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode((json_path, ranks_path, pattern)), "doc_id bigint, ids array<int>")


def round_trips(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: token count, digest of the ids and of the text that they decode to.

    Null text counts as empty (0 tokens). Strings of special tokens inside a text become those tokens, as the library
    has it by default. Texts are encoded whole, at any length. Rows are independent, so repeated rows and ids repeat
    their results; columns besides the two named are ignored. An empty table gives no rows.
    """
    need(docs, [id_col, text_col])
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_digests((json_path, ranks_path, pattern)), schema)
