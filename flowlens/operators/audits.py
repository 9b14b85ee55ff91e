"""Checks on rows, columns and files: windows, payloads, chronology, splits, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import squeezed
from flowlens.operators.ordered import merged_intervals

#: Fixed names of columns that identify a flow's origin and must not be features.
IDENTITY_COLUMNS = (
    "src_mac", "dst_mac", "src_ip", "dst_ip", "src_oui", "dst_oui", "flow_id", "device_id", "capture_id", "file_id",
    "attack_file", "pcap_path", "pcap_file", "filename", "bidirectional_first_seen_ms", "bidirectional_last_seen_ms",
)


def identity_leaks(columns: list[str]) -> list[str]:
    """Which columns give away where a row comes from, in the order given."""
    return [c for c in columns if c.lower() in IDENTITY_COLUMNS]


def web_subtype(label: Column) -> Column:
    """Subtype of a web attack by its label; null for other labels."""
    text = F.lower(squeezed(label))
    kinds = (("brute force", "Brute Force-Web"), ("xss", "XSS"), ("sql", "SQL Injection"))
    return F.when(text.contains("web attack"), F.coalesce(*[F.when(text.contains(k), v) for k, v in kinds]))


def infiltration_window(klass: Column, ts: Column) -> Column:
    """Which of the day's two infiltration windows a row is in; they part at 16:00."""
    return (
        F.when(~klass.eqNullSafe(F.lit("Infiltration")), "not_infiltration")
        .when(ts.isNull(), "missing_timestamp")
        .when(F.hour(ts) < 16, "early_13_14h")
        .otherwise("late_18_19h")
    )


def safety_flags(finite: dict[str, Column], nonzero: Column, highest: Column) -> Column:
    """Names of what is wrong with a record: parts that aren't finite, payloads empty or over 60 % non-zero."""
    share, top = F.coalesce(nonzero, F.lit(0.0)), F.coalesce(highest, F.lit(0.0)).cast("double")
    endless = F.isnan(top) | (F.abs(top) == float("inf"))
    return F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in finite.items()],
            F.when((share == 0) | (share > 0.60), "payload_nonzero_fraction_outlier"),
            F.when(endless, "flow_max_nonfinite"),
        )
    )


def in_windows(packets: DataFrame, windows: DataFrame, keys: list[str], ts: str, start: str, finish: str) -> DataFrame:
    """Packets within any window of their key, ends included; a window without one of its ends holds none. Windows are merged first, so few are left to compare."""
    known = windows.filter(F.col(start).isNotNull() & F.col(finish).isNotNull())
    merged = merged_intervals(known, keys, start, finish).select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col(start).alias("w_start"), F.col(finish).alias("w_finish"))
    on = F.col(ts).between(F.col("w_start"), F.col("w_finish"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"w_{k}"))
    return packets.join(merged, on, "left_semi")


def window_payloads(pairs: DataFrame, row: str, order: list[str], payload: str, cap: int = 65_536) -> DataFrame:
    """Per row the payloads of its packets in order, up to the packet with which ``cap`` bytes are reached."""
    before = Window.partitionBy(row).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sized = pairs.withColumn("_before", F.coalesce(F.sum(F.octet_length(payload)).over(before), F.lit(0)))
    item = F.struct(*order, F.col(payload).alias("_payload"))
    kept = sized.filter(F.col("_before") < cap).groupBy(row).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return kept.select(row, F.size("_items").cast("bigint").alias("n_packets"), F.concat_ws("\n", F.col("_items._payload")).alias("payload"))


def chronology(df: DataFrame, source: str, chunk: str, ts: str) -> DataFrame:
    """First and last time of each chunk of a source; how far it starts after the one before, and whether they overlap."""
    ends = df.groupBy(source, chunk).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    before = F.lag("last_ts").over(Window.partitionBy(source).orderBy(chunk))
    return ends.withColumns({"gap": F.col("first_ts") - before, "overlaps": F.coalesce(F.col("first_ts") < before, F.lit(False))})


def imbalance(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows wanted and rows found per key, and how many are short."""
    n, want = F.coalesce("n", F.lit(0)), F.coalesce("target", F.lit(0))
    return targets.join(counts, keys, "full").select(*keys, want.alias("target"), n.alias("n"), F.greatest(want - n, F.lit(0)).alias("short"))


def mismatches(left: DataFrame, right: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row per key and attribute whose two values differ; null differs from any value."""
    other = right.select(key, *[F.col(a).alias(f"_{a}") for a in attributes])
    found = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("expected"), F.col(f"_{a}").cast("string").alias("found")) for a in attributes])
    rows = left.join(other, key).select(key, F.inline(found))
    return rows.filter(~F.col("expected").eqNullSafe(F.col("found")))


def early_stopping(df: DataFrame, run: list[str], step: str, score: str, patience: int) -> DataFrame:
    """The best score so far, steps since it was first reached, and whether patience has run out."""
    so_far = Window.partitionBy(*run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_best = df.withColumns({"best": F.max(score).over(so_far), "_n": F.row_number().over(Window.partitionBy(*run).orderBy(step))})
    reached = F.min("_n").over(Window.partitionBy(*run, "best"))
    stale = (F.col("_n") - reached).cast("bigint")
    return with_best.withColumn("stale", stale).withColumn("stop", F.col("stale") >= patience).drop("_n")


def split_targets(size: Column, train: int, val: int, test: int, threshold: int) -> Column:
    """Rows of a class for train, val and test: fixed numbers for large classes, in proportion for the others."""
    t = F.bround(size * train / threshold).cast("bigint")
    v = F.bround(size * val / threshold).cast("bigint")
    rest = F.greatest(size - t - v, F.lit(0))
    short = (t < 1) & (size > 0)
    small = F.struct(
        F.when(short, 1).otherwise(t).cast("bigint").alias("train"),
        F.when(short & (rest <= 0) & (v > 0), v - 1).otherwise(v).cast("bigint").alias("val"),
        F.when(short & (rest > 0), rest - 1).otherwise(rest).cast("bigint").alias("test"),
        F.lit("proportional_targets").alias("mode"),
    )
    large = F.struct(
        F.greatest(size - val - test, F.lit(0)).cast("bigint").alias("train"),
        F.lit(val).cast("bigint").alias("val"), F.lit(test).cast("bigint").alias("test"), F.lit("fixed_targets").alias("mode"),
    )
    return F.when(size >= threshold, large).otherwise(small)


def content_split(df: DataFrame, klass: str, content: str, train: int, val: int, test: int, threshold: int) -> DataFrame:
    """df with split; rows with equal content go to one split.

    The targets of a class are those of split_targets for its rows. Its groups are walked in order of their content: a
    group goes to test while that is short and has no more rows than val (or val is full), else to val while that is
    short, else to train; the very last group trains if none did before. A group that is not trained on adds a row at
    least, so only the first val + test groups of a class can go elsewhere: those few are walked, one class a task, and
    everything behind them trains.
    """
    groups = df.groupBy(klass, content).agg(F.count(F.lit(1)).alias("_size"))
    totals = groups.groupBy(klass).agg(F.sum("_size").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    reach = val + test + 2  # proportional targets are rounded
    early = groups.withColumn("_rank", F.row_number().over(Window.partitionBy(klass).orderBy(content))).filter(F.col("_rank") <= reach)
    targets = split_targets(F.col("_rows"), train, val, test, threshold)
    early = early.join(totals.withColumn("_t", targets), klass).select(klass, content, "_size", "_rank", "_groups", F.col("_t.val").alias("_val"), F.col("_t.test").alias("_test"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        held, short, trained, out = {"val": 0, "test": 0}, {k: int(rows[f"_{k}"].iloc[0]) for k in ("val", "test")}, False, []
        for size, rank, last in zip(rows["_size"], rows["_rank"], rows["_groups"], strict=True):
            if rank == last and not trained:
                to = "train"
            elif held["test"] < short["test"] and (held["test"] <= held["val"] or held["val"] >= short["val"]):
                to = "test"
            else:
                to = "val" if held["val"] < short["val"] else "train"
            trained = trained or to == "train"
            if to != "train":
                held[to] += size
            out.append(to)
        return rows[[klass, content]].assign(split=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(klass, content).schema)
    placed = early.groupBy(klass).applyInPandas(walk, f"{fields}, split string").filter("split <> 'train'")
    return df.join(placed, [klass, content], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def value_ranges(df: DataFrame, by: str, value: str, kind: str) -> DataFrame:
    """Smallest and largest value and how often each kind occurs (kind=count, in order of kind), per group."""
    counts = df.groupBy(by, kind).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    text = F.concat_ws("=", F.col(kind).cast("string"), F.col("_n").cast("string"))
    return counts.groupBy(by).agg(
        F.min("_lo").alias("lowest"), F.max("_hi").alias("highest"), F.sum("_n").alias("n"), F.concat_ws("|", F.array_sort(F.collect_list(text))).alias("histogram")
    )
