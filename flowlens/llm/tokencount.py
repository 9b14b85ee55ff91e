"""Token counts of huge documents by overlap resynchronisation.

A long text is encoded in overlapping chunks with offsets. A token boundary that both neighbours have inside their
overlap is a place to splice if it is proven stable: no vocabulary piece holds the two characters on its sides next to
each other, so no merge of either encoding, nor of the whole text's, reaches over it. If an overlap holds none, it is
widened, up to the rest of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import need, ship

CHUNK, OVERLAP = 16_384, 256
_SPACE = "▁"
_loaded: dict[str, ResyncCounter] = {}


class ResyncCounter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.chunk, self.overlap = chunk, overlap
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.inside: set[str] = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                self.inside.update(piece[k : k + 2] for k in range(len(piece) - 1))
        # Splicing rests on characters being encoded as they stand, apart from the space in front of the text.
        probe = " a  \t\n éﬁ Ａ z  "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError(f"{path} changes characters before it encodes them: chunks of a text cannot be spliced with it")

    def stable(self, data: bytes, at: int) -> bool:
        """No piece holds the two characters on both sides of byte at next to each other."""
        i, j = at - 1, at + 1
        while data[i] & 0xC0 == 0x80:
            i -= 1
        while j < len(data) and data[j] & 0xC0 == 0x80:
            j += 1
        return data[i:j].decode("utf-8").replace(" ", _SPACE) not in self.inside

    def _starts(self, data: bytes, start: int, end: int) -> list[int]:
        """Byte offsets in data at which the tokens of data[start:end] begin, one for each token."""
        found = self.model.encode(data[start:end].decode("utf-8"), return_type="proto")
        return [start + p.begin for p in found.pieces]

    def count(self, text: str) -> int:
        if len(text) <= 2 * self.chunk:
            return len(self.model.encode(text))
        data = text.encode("utf-8")

        def whole(at: int) -> int:  # the next start of a character
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(data))

        total = start = came_from = 0  # a chunk is read from start; its tokens count from came_from
        while True:
            end, width = whole(start + self.chunk), self.overlap
            while True:
                stop = whole(end + width)
                mine = self._starts(data, start, stop)
                if stop == len(data):
                    return total + sum(x >= came_from for x in mine)
                # The neighbour starts at the overlap. Its first token holds the added space and is no place to splice.
                theirs = set(self._starts(data, end, whole(stop + self.overlap)))
                common = (x for x in mine if max(end, came_from) < x < stop and x in theirs)
                splice = next((x for x in common if self.stable(data, x)), None)
                if splice is not None:
                    break
                width *= 4
            total += sum(came_from <= x < splice for x in mine)
            start, came_from = end, splice


def counter(path: str) -> ResyncCounter:
    if path not in _loaded:
        _loaded[path] = ResyncCounter(path)
    return _loaded[path]


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: UTF-8 bytes, tokens without begin and end, and whether there are more than limit.

    Null text counts as empty with 0 tokens. Texts are counted whole, at any length. Rows are independent, so repeated
    rows and ids repeat their results; columns besides the two named are ignored. An empty table gives no rows. A model
    that normalises characters is refused, since its chunks could not be spliced.
    """
    need(docs, [id_col, text_col])
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(model_path, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
