"""Window and ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowlens.functions.scalars import micros
from flowlens.operators.ranks import by_hash, ranked
from flowlens.operators.runs import key_changes


def merged_intervals(df: DataFrame, keys: list[str], start: str, finish: str) -> DataFrame:
    """Intervals of each key with overlapping and touching ones as one.

    Rows without a start come last and count with the last interval; where a key has no others, they are one row.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(finish))
    before = F.max(finish).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("opens", F.coalesce(F.col(start) > before, before.isNull() & F.col(start).isNotNull()).cast("int"))
    island = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(finish).alias(finish), F.count(F.lit(1)).alias("merged")).drop("island")


def gap_islands(df: DataFrame, keys: list[str], order: list[str], ts: str, gap_seconds: float, name: str = "island", beyond: bool = False) -> DataFrame:
    """Number the runs of rows of each key that no gap parts.

    A gap of exactly gap_seconds parts rows, as flows end at their timeout; with ``beyond`` only a longer one does, as
    active periods end.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = (micros(ts) - micros(F.lag(ts).over(w))) / F.lit(1e6)
    parts = gap > gap_seconds if beyond else gap >= gap_seconds
    opens = F.when(gap.isNull() | parts, 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def timeout_flows(df: DataFrame, keys: list[str], ts: str, idle: float, active: float) -> DataFrame:
    """Flows of each key that close at min(first + active, last + idle), an event at that very time opening the next.

    Rows are dealt by key and sorted by time (Spark spills the sort), then pass as a stream: of what went before, a task
    holds the open flow only, its key, first and last time and count. A key's events pass one task. Null times are dropped.
    """
    idle_us, active_us = round(idle * 1e6), round(active * 1e6)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], micros(ts).cast("bigint").alias("us")).filter("us is not null")
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "us")
    fields = [dealt.schema[n] for n in names]
    schema = StructType([*fields, *[StructField(n, LongType()) for n in ("first", "last", "n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open flow: key as a batch of one row, first, last, n
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            key, us = batch.select(names), batch.column(len(names)).to_numpy()
            turns = [0, *(np.flatnonzero(key_changes(key)) + 1).tolist(), size]
            done = []  # key as a batch of one row, first, last, n
            for start, stop in zip(turns, turns[1:], strict=False):
                times, one = us[start:stop], key.slice(start, 1)
                far = (np.flatnonzero(np.diff(times) >= idle_us) + 1).tolist() + [len(times)]  # where idle gaps end
                at = gap = 0
                if held is not None and (start or key_changes(pa.Table.from_batches([held[0], one]).combine_chunks().to_batches()[0]).any()):
                    done.append(held)
                    held = None
                while at < len(times):
                    first, last, n = (times[at], None, 0) if held is None else held[1:]
                    while far[gap] <= at:
                        gap += 1
                    if last is not None and times[at] - last >= idle_us:
                        end = at
                    else:  # a new flow takes its first event whatever active is
                        end = max(at + (last is None), min(far[gap], int(np.searchsorted(times, first + active_us))))
                    if end > at:
                        last, n = times[end - 1], n + end - at
                    held = (one, first, last, n)
                    at = end
                    if at < len(times):
                        done.append(held)
                        held = None
            if done:
                yield _flows(done, names)
        if held is not None:
            yield _flows([held], names)

    flows = dealt.mapInArrow(run, schema)
    return flows.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
        (F.col("first") / F.lit(1e6)).alias("first_seen"), (F.col("last") / F.lit(1e6)).alias("last_seen"), F.col("n").alias("n_events"),
    )


def _flows(done: list, names: list[str]) -> pa.RecordBatch:
    key = pa.Table.from_batches([d[0] for d in done]).combine_chunks().to_batches()[0]
    counts = [pa.array([int(d[i]) for d in done], pa.int64()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays([*key.columns, *counts], [*names, "first", "last", "n"])


def peak_concurrency(df: DataFrame, keys: list[str], start: str, finish: str) -> DataFrame:
    """The most intervals open at once for each key; an interval that ends when another starts is closed first.

    Changes are summed by time before the running sum, so many intervals with equal ends cost one row.
    """
    steps = df.select(*keys, F.col(start).alias("at"), F.lit(1).alias("step")).union(df.select(*keys, F.col(finish).alias("at"), F.lit(-1).alias("step")))
    summed = steps.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return summed.withColumn("open", F.sum("step").over(w)).groupBy(*keys).agg(F.max("open").alias("peak"))


def segments(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Number the runs of ``size`` rows within each key."""
    return ranked(df, keys, order, "_rank").withColumn("segment", F.floor((F.col("_rank") - 1) / size).cast("bigint")).drop("_rank")


def link_deltas(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """From each row but the last of a key to the next: the change of value, at least 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    after = F.lead(value).over(w)
    return df.withColumn("delta", F.greatest(after - F.col(value), F.lit(0))).withColumn("_after", after).filter("_after is not null").drop("_after")


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int, hashed: str | None = None) -> DataFrame:
    """The first n rows of each key.

    Up to 999 rows Spark itself cuts each task's groups before the shuffle. For more, rows are ranked in ranges, so that no
    key is one task; hashed names the first order column if it holds hexadecimal hashes, and then most rows of large keys
    go before they are dealt.
    """
    if n < 1000:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
    near = by_hash(df, keys, hashed, n)[0] if hashed else df
    return ranked(near, keys, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def round_robin(df: DataFrame, bucket: str, order: list, n: int) -> DataFrame:
    """n rows, one of each bucket in turn; buckets with more rows go first, then by name."""
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_size"))
    placed = ranked(df, [bucket], order, "_round").filter(F.col("_round") <= n).join(sizes, bucket)
    return placed.orderBy("_round", F.desc("_size"), bucket).limit(n).drop("_size").withColumnRenamed("_round", "round")


def even_take(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key at even distances in order: places round(i * (size - 1) / (n - 1)), half to even; one row: the middle."""
    placed = ranked(df, keys, order, "place").withColumn("place", F.col("place") - 1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    if n == 1:
        wanted = sizes.select(*keys, F.floor(F.col("size") / 2).cast("bigint").alias("place"))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("size") - 1) / F.lit(float(n - 1))).cast("bigint"))
        every = F.sequence(F.lit(0).cast("bigint"), F.least("size", F.lit(n)) - 1)
        wanted = sizes.select(*keys, F.explode(F.when(F.col("size") <= n, every).otherwise(F.array_distinct(places))).alias("place"))
    return placed.join(wanted, [*keys, "place"])
