"""Stateful operators on streams: flows with timeouts, and trailing features over a key's last rows.

State is bounded for each key: three numbers for an open flow, at most ``rows`` small vectors for a trailing window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.functions.scalars import micros


def flows(events: DataFrame, keys: list[str], ts: str, idle: float, active: float, delay: str = "0 seconds") -> DataFrame:
    """Closed flows (keys, first_seen, last_seen, n_events) of a stream; append mode.

    A flow closes at min(first + active, last + idle) seconds: by an event of its key at that time or later, which opens
    the next flow, or by the watermark. Events older than the watermark (delay behind the latest) are dropped. Within a
    micro-batch events are taken in order of time; one that is older than the flow's last does not set it back. Rows
    without a time are left out.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull())
    rows = timed.withWatermark(ts, delay).select(*keys, ts, micros(ts).alias("_us"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*keys).schema)
    idle_us, active_us = int(idle * 1e6), int(active * 1e6)
    names = [*keys, "first_us", "last_us", "n_events"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done = [(*key, *state.get)]
            state.remove()
            yield pd.DataFrame(done, columns=names)
            return
        first, last, n = state.get if state.exists else (0, 0, 0)
        done = []
        for x in np.sort(np.concatenate([b["_us"].to_numpy() for b in batches])).tolist():
            if n and x >= min(first + active_us, last + idle_us):
                done.append((*key, first, last, n))
                n = 0
            first, last, n = (first, max(last, x), n + 1) if n else (x, x, 1)
        closes = -(-min(first + active_us, last + idle_us) // 1000)
        if closes <= state.getCurrentWatermarkMs():
            done.append((*key, first, last, n))
            if state.exists:
                state.remove()
        else:
            state.update((first, last, n))
            state.setTimeoutTimestamp(closes)
        if done:
            yield pd.DataFrame(done, columns=names)

    found = rows.groupBy(*keys).applyInPandasWithState(
        run, f"{kinds}, first_us bigint, last_us bigint, n_events bigint", "first bigint, last bigint, n bigint",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(
        *keys, F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"), "n_events"
    )


def trailing_features(
    events: DataFrame, keys: list[str], id_col: str, ts: str, rows: int, sums: list[str], distinct: list[str]
) -> DataFrame:
    """For each event (id): sums and distinct non-zero counts of numeric columns over the ``rows`` events before it.

    Order is that of arrival; events of one micro-batch are taken by time, then id. Nulls count as 0.
    """
    values = [*sums, *distinct]
    plain = events.select(*keys, F.col(id_col).cast("bigint").alias("_id"), micros(ts).alias("_us"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values])
    width = len(values)
    names = ["id", *[f"{c}_sum" for c in sums], *[f"{c}_distinct" for c in distinct]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values(["_us", "_id"])
        old = np.frombuffer(state.get[0]).reshape(-1, width) if state.exists else np.empty((0, width))
        every = np.concatenate([old, new[values].to_numpy(dtype=float)])
        at = np.arange(len(old), len(every))
        low = np.maximum(at - rows, 0)
        total = np.concatenate([np.zeros((1, width)), np.cumsum(every, axis=0)])
        out = {"id": new["_id"].to_numpy()}
        for k, c in enumerate(sums):
            out[f"{c}_sum"] = total[at, k] - total[low, k]
        for k, c in enumerate(distinct, len(sums)):
            out[f"{c}_distinct"] = [len(set(every[i:j, k].tolist()) - {0.0}) for i, j in zip(low.tolist(), at.tolist(), strict=True)]
        state.update((every[-rows:].tobytes(),))
        yield pd.DataFrame(out)[names]

    schema = ", ".join(["id bigint", *[f"`{c}_sum` double" for c in sums], *[f"`{c}_distinct` bigint" for c in distinct]])
    return plain.groupBy(*keys).applyInPandasWithState(run, schema, "seen binary", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, ends: DataFrame | None = None, end_path: str | None = None) -> DataFrame:
    """Run a stream over all that its sources hold now, into Parquet below path, and read that; append mode.

    With ends, one of the sources reads end_path, and ends is what is written there when everything else has been read:
    rows later than all others, which move the watermark past whatever is open.
    """

    def run() -> None:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if ends is not None:
        ends.write.mode("append").parquet(end_path)
        run()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def with_end(stream: DataFrame, ts: str, end_path: str) -> tuple[DataFrame, DataFrame]:
    """(stream and the rows of end_path, the row to write there): a last event with null in all columns but ts, in the year 2200.

    Flows of a null key are closed by it like all others; the flow that it opens itself stays open.
    """
    spark = stream.sparkSession
    last = [F.timestamp_seconds(F.lit(7_258_118_400)).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(end_path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(end_path)), spark.range(1).select(*last)
