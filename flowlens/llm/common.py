"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.scratch import cut, cut_with, new_path, shared_dir  # noqa: F401  the operators take them from here

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A scan that is read once for heavy work per row: dealt to all cores if its files split into fewer parts."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-"), "flowlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once; a plain reference inside a lambda would be worked out per element."""
    return F.transform(F.array(value), body)[0]


def small_side(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast a side of known row count with narrow rows up to limit rows; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Sequence[str], rows: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """many joined with few, which has each key once and no other column of many; a key may hold a third of many's rows.

    Up to 100,000 rows few is broadcast. Beyond that each of its rows is sent to ``salts`` places, among which the rows
    of many with its key are dealt by the hash of their columns ``spread``.
    """
    if rows <= 100_000:
        return many.join(F.broadcast(few), keys, how)
    everywhere = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(everywhere, [*keys, "_salt"], how).drop("_salt")


def need(df: DataFrame, wanted: Sequence[str]) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that df has no column of, in any case of letters; for helper columns."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def named(column: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")
