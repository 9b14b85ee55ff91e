"""Labelled CSV, JSON lines, file registries and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.ordered import first_per_key

#: Fixed header names of label columns, in small letters without separators.
LABEL_NAMES = ("label", "class", "attack", "attacktype")


def label_column(columns: list[str]) -> str | None:
    """The first column whose name, in small letters without white space and separators, is that of a label."""
    plain = {c: "".join(x for x in c.lower() if x.isalnum()) for c in columns}
    return next((c for c in columns if plain[c] in LABEL_NAMES), None)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under trimmed names without a byte order mark; bad bytes become replacement characters."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that df has and that isn't empty in the row; null if there is none."""
    found = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines give no row. With a schema the files are read once."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).dropna("all")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with its keys in order of name."""
    df.select(*sorted(df.columns)).write.json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, modified and sha256 of every file below path; contents are read one file a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"),
    )


def captures_by_ip(files: DataFrame) -> DataFrame:
    """(ip, files sorted) from names that hold a dotted address."""
    ip = F.regexp_extract("name", r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})", 1)
    return files.withColumn("ip", ip).filter("ip <> ''").groupBy("ip").agg(F.array_sort(F.collect_set("path")).alias("files"))


def chunk_order(name: Column) -> Column:
    """Sort key of split captures: five or more digits at the end of the stem, then a number after the ending, then the name.

    Numbers are compared as wholes, by their length and then their digits, so none is too long.
    """
    digits, suffix = F.regexp_extract(name, r"([0-9]{5,})(?:\.[^.]*)?$", 1), F.regexp_extract(name, r"\.pcap([0-9]+)$", 1)
    kind = F.when(digits != "", 0).when(suffix != "", 1).otherwise(2)
    number = F.regexp_replace(F.when(digits != "", digits).otherwise(suffix), "^0+", "")
    return F.struct(kind.alias("kind"), F.length(number).alias("length"), number.alias("number"), name.alias("name"))


def mark_done(df: DataFrame, path: str, key: str = "identity") -> None:
    """Append identities to a registry of finished work; marking twice does no harm, as it is read as a set."""
    df.select(key).distinct().write.mode("append").parquet(path)


def not_done(df: DataFrame, path: str, key: str = "identity") -> DataFrame:
    return df.join(df.sparkSession.read.schema(df.select(key).schema).parquet(path), key, "left_anti")


def write_shards(df: DataFrame, path: str, klass: str, id_col: str, rows: int, seed: int) -> None:
    """Parquet shards of at most ``rows`` rows under a folder per class, dealt by the hash of seed and id."""
    order = F.xxhash64(F.lit(seed), id_col)
    df.withColumn("_h", order).repartitionByRange(klass, "_h").sortWithinPartitions(klass, "_h").drop("_h").write.option(
        "maxRecordsPerFile", rows
    ).partitionBy(klass).parquet(path)


def markdown_cell(x: Column) -> Column:
    """Pipes escaped and line breaks as spaces; null is empty."""
    return F.coalesce(F.regexp_replace(F.replace(x.cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit(""))


def markdown_rows(df: DataFrame) -> DataFrame:
    """One column ``line`` with a table row of Markdown for each row of a report."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in df.columns]), F.lit(" |")).alias("line"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as CSV with a header; reports are aggregates, so one file will do."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sample_export(df: DataFrame, klass: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each class in the given order."""
    return first_per_key(df, [klass], order, n)
