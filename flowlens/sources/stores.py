"""Stores of records and what is known of files: discovery, paths by day, record pools, temporal indexes, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import file_name, file_stem, stable_hash
from flowlens.operators.ranks import ranked
from flowlens.sources.tables import chunk_order

SCHEMA_VERSION = 1


def day_paths(day: Column, root: str) -> Column:
    """Where a day's files are below root: improved and original CSV, and the folder of its captures."""
    base = root.rstrip("/")
    return F.struct(
        F.concat(F.lit(f"{base}/improved/"), day, F.lit(".csv")).alias("improved_csv"),
        F.concat(F.lit(f"{base}/original/"), day, F.lit("_TrafficForML_CICFlowMeter.csv")).alias("original_csv"),
        F.concat(F.lit(f"{base}/raw/"), day, F.lit("/pcap")).alias("captures"),
    )


def discovered(files: DataFrame, largest: int) -> DataFrame:
    """files(path, size) of captures with subtype, place (in natural order of chunks) and status.

    A subtype's file of more than ``largest`` bytes is skipped: where it has chunks they stand for it, else it must be
    split first.
    """
    stem = file_stem(F.regexp_replace(file_name(F.col("path")), r"\.pcap[0-9]*$", ".pcap"))
    named = files.withColumn("subtype", F.regexp_replace(stem, r"[_-]+$", ""))
    big = F.col("size") > largest
    chunks = F.count_if(~big).over(Window.partitionBy("subtype"))
    status = F.when(~big, "use").when(chunks > 0, "skipped_has_chunks").otherwise("skipped_needs_split")
    order = Window.partitionBy("subtype").orderBy(chunk_order(file_name(F.col("path"))), "path")
    return named.withColumns({"status": status, "place": F.row_number().over(order) - 1})


def independent(files: DataFrame, known: list[str]) -> DataFrame:
    """Captures and CSV files whose path names none of the known data sets."""
    low = F.lower("path")
    out = files.filter(F.regexp_like(low, F.lit(r"\.(pcap|pcapng|csv)$")))
    for name in known:
        out = out.filter(~low.contains(name.lower()))
    return out


def write_records(records: DataFrame, path: str, split: str, klass: str, id_col: str) -> None:
    """A pool of records as Parquet by split and class, each with its ordinal in its class and a stable graph_id."""
    ids = stable_hash(F.col(split), F.col(klass), F.col(id_col))
    placed = ranked(records, [split, klass], [id_col], "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    placed.withColumn("graph_id", ids).write.mode("overwrite").partitionBy(split, klass).parquet(path)


def read_records(spark: SparkSession, path: str, split: str, value: str, klass: str, limit_per_class: int = 0) -> DataFrame:
    """The records of one split, of each class the first limit_per_class (0: all); only that split's folders are read."""
    rows = spark.read.parquet(path).filter(F.col(split) == value)
    return rows if limit_per_class <= 0 else rows.filter(F.col("ordinal") < limit_per_class)


def replace_parts(df: DataFrame, path: str, parts: list[str]) -> None:
    """Write df over the parts of a pool that it has rows of; all other parts stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_index(entries: DataFrame, path: str, window_size: int, day: str = "day") -> None:
    """A temporal index as Parquet by day, every row with the schema version and the window it was made for."""
    entries.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "window_size": F.lit(window_size)}).write.mode("overwrite").partitionBy(day).parquet(path)


def read_index(spark: SparkSession, path: str, window_size: int) -> DataFrame:
    """The entries of a temporal index; one made by another schema or for another window is an error."""
    rows = spark.read.parquet(path)
    found = [tuple(r) for r in rows.select("schema_version", "window_size").distinct().limit(20).collect()]
    if any(f != (SCHEMA_VERSION, window_size) for f in found):
        raise ValueError(f"the index has (schema, window) {found}, not {(SCHEMA_VERSION, window_size)}")
    return rows.drop("schema_version", "window_size")


def reconciled(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a pool of JSON lines: what can be read by the schema, and file and text of what cannot."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _reject string", {"columnNameOfCorruptRecord": "_reject"}))
    good = parsed.filter("r._reject is null").select("r.*", "file").drop("_reject")
    return good, parsed.filter("r._reject is not null").select("file", F.col("value").alias("text"))
