"""Exact ranks within keys without gathering a key: the rank of a row is the offset of its range and its place in it.

Rows are dealt to sorted ranges of (keys, order), so a large key is cut into several of them. A row's place among the rows
of its key in its range is counted as the range passes. Only the first key of a range can have rows in the ranges before;
how many is worked out from two rows a range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from flowlens.operators.runs import key_changes
from flowlens.scratch import cut, cut_with

_MARKS = [StructField("_range", IntegerType()), StructField("_place", LongType()), StructField("_first", BooleanType()), StructField("_end", BooleanType())]


def _places(keys: list[str], names: list[str]):
    """Rows of a sorted range with their place in their key's run, whether that run is the range's first, and the last row marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = held = None  # the key of the row before; the last row, whose mark is not known yet
        length, first = 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.select(keys)
            opens = last is not None and bool(keys) and bool(key_changes(pa.Table.from_batches([last, key.slice(0, 1)]).combine_chunks().to_batches()[0]).any())
            turns = np.concatenate(([opens], key_changes(key) if keys else np.zeros(n - 1, bool)))
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(turns, at, -1))
            place = np.where(start < 0, length + at, at - start)
            in_first = first & (np.cumsum(turns) == 0)
            length, first, last = int(place[-1]) + 1, bool(in_first[-1]), key.slice(n - 1, 1)
            done = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place, pa.int64()), pa.array(in_first), pa.array(np.zeros(n, bool))], names
            )
            if held is not None:
                yield held
            if n > 1:
                yield done.slice(0, n - 1)
            held = done.slice(n - 1, 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array([True])], names)

    return run


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with the rank of each row within its keys in that order, from 1; without keys, among all rows.

    order must tell rows apart: rows equal in keys and order are ranked in any order, in one task. Null keys are one key.
    A column of that name is replaced; an empty table stays empty. ranges is how many ranges there are (default: the
    session's shuffle partitions).
    """
    base, keys = df.drop(name), list(keys)
    by = [*keys, *order]
    dealt = base.repartitionByRange(ranges, *by) if ranges else base.repartitionByRange(*by)
    schema = StructType([*base.schema, *_MARKS])
    written = cut(dealt.sortWithinPartitions(*by).mapInArrow(_places(keys, schema.names), schema), "places")
    # Two rows a range at most: its first and its last one.
    key = F.struct(F.lit(0).alias("all"), *[F.col(k) for k in keys])
    edges = written.filter("_end or (_first and _place = 0)").groupBy("_range").agg(
        F.max(F.when(F.col("_first") & (F.col("_place") == 0), F.struct(F.lit(1).alias("there"), key.alias("key"))))["key"].alias("first"),
        F.max_by(key, "_end").alias("last"), F.max(F.when(F.col("_end"), F.col("_place") + 1)).alias("rows"),
    )
    line = Window.orderBy("_range")
    before = edges.withColumns({"total": F.sum("rows").over(Window.partitionBy("last").orderBy("_range")), "seen": F.lag("last").over(line)})
    before = before.withColumn("_offset", F.when(F.col("first").eqNullSafe(F.col("seen")), F.lag("total").over(line)).otherwise(0))
    placed = written.join(F.broadcast(before.select("_range", "_offset")), "_range", "left")
    rank = F.col("_place") + 1 + F.when(F.col("_first"), F.col("_offset")).otherwise(0)
    return placed.withColumn(name, rank).select(*base.columns, name)


def by_hash(df: DataFrame, keys: Sequence[str], score: str, n: int) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows among which the first n of each key in the order of a hexadecimal hash are, with few others; the rest.

    Rows of each key are counted by the first three digits of their hash; those digits at which a key's count reaches n
    bound what is kept, so most rows of large keys go before any shuffle. Keys of fewer rows keep all.
    """
    digits = F.substring(score, 1, 3)
    counts = df.groupBy(*keys, digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_digits")  # 4,096 rows a key at most
    upto = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).filter(F.col("_before") < n)
    bounds, seen = cut_with(upto.groupBy(*keys).agg(F.max("_digits").alias("_digits")), "bounds", keys=F.count(F.lit(1)))
    bounds = bounds.toDF(*[f"_k{i}" for i in range(len(keys))], "_bound")
    same = digits <= F.col("_bound")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    small = F.broadcast(bounds) if seen["keys"] <= 100_000 else bounds
    return df.join(small, same, "left_semi"), df.join(small, same, "left_anti")
