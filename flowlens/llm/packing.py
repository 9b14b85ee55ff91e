"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt at random into blocks of bounded
size, each packed in one task on its own: a bin takes the longest piece that is left, then again and again the longest
that fits; then its smallest piece is given back if two other pieces fit the wider gap more tightly. With tens of
thousands of pieces a block, what dealing into blocks loses is the last few bins of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, need, ship
from flowlens.llm.wordbpe import word_bpe

CAPACITY, BLOCK_ROWS, END_ID = 2048, 50_000, 0
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are from 1 to capacity."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths.tolist()):
        waiting[n].append(i)
    there = sum(1 << n for n in range(1, capacity + 1) if waiting[n])  # bit n: pieces of length n are left
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def longest(most: int, mask: int) -> int:
        return (mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        i = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
        return i

    number = 0
    while there:
        filled, gap = [], capacity
        while (n := longest(gap, there)) > 0:
            filled.append((n, take(n)))
            gap -= n
        if gap and len(filled) > 1:
            small, back = filled[-1]  # pieces were taken in falling order
            room, best = small + gap, (small, 0, 0)
            a = longest(room - 1, there)
            while a > 0 and best[0] < room and 2 * a >= best[0]:
                mask = there if len(waiting[a]) > 1 else there & ~(1 << a)
                b = longest(min(room - a, a), mask)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = longest(a - 1, there)
            if best[1]:
                filled[-1:] = [(best[1], take(best[1])), (best[2], take(best[2]))]
                waiting[small].append(back)
                there |= 1 << small
        at = 0
        for n, i in filled:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, end = word_bpe(path).packed, END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = packed(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the id 0; null and empty texts are the single id 0. Only documents longer than capacity
    are cut. Rows that repeat an id are packed each on its own; null ids are allowed. Columns besides the two named are
    ignored. An empty table gives no rows.
    """
    need(docs, [id_col, text_col])
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(_pieces(tokenizer_path, capacity), _PIECES), "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)))

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(block["length"].to_numpy(), capacity)
        return block.drop(columns="block").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return dealt.groupBy("block").applyInPandas(run, f"{_PIECES}, sequence_id bigint, offset bigint")
