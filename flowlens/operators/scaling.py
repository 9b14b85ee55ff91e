"""Normalisers that are fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.ranks import ranked


def fit_standard(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """One row: mean and population deviation of each column over training rows; a deviation of 0 counts as 1."""
    fitted = df.filter(train).agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    return fitted.withColumns({f"{c}_std": F.when(F.coalesce(f"{c}_std", F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns})


def scaled(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    """df with each column standardised; fitted is one row."""
    both = df.crossJoin(F.broadcast(fitted))
    return both.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*fitted.columns)


def quantile(df: DataFrame, value: Column, q: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """One row: the exact q-quantile of the numbers in value, between two rows in proportion; null if there are none.

    A sketch says between which two values the rank lies; rows below are counted, and only the few distinct values
    between are put in order. So no task holds more than some 4 / accuracy of the values, whatever the table's size.
    """
    x = df.select(value.cast("double").alias("x")).filter("x is not null and not isnan(x)")
    near = F.percentile_approx("x", F.lit([max(q - 2 / accuracy, 0.0), min(q + 2 / accuracy, 1.0)]), F.lit(accuracy))
    n, ends = x.agg(F.count(F.lit(1)), near).first()  # one row
    spark = df.sparkSession
    if not n:
        return spark.range(1).select(F.lit(None).cast("double").alias(name))
    low, high = ends
    place = q * (n - 1)
    first, part = int(place), place - int(place)
    # Ranks are counted in another way by the sketch, so the next value on either side may be asked for too.
    outside = x.agg(F.count_if(F.col("x") < low).alias("below"), F.max(F.when(F.col("x") < low, F.col("x"))).alias("last"), F.min(F.when(F.col("x") > high, F.col("x"))).alias("next"))
    inside = x.filter(F.col("x").between(low, high)).groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", upto).crossJoin(F.broadcast(outside))  # one row

    def at(rank):
        return F.when(F.max("below") > rank, F.max("last")).otherwise(F.min(F.when(F.col("below") + F.col("upto") > rank, F.col("x"))))

    both = ranked.agg(at(first).alias("a"), F.coalesce(at(first + 1), F.max("next")).alias("b"))
    return both.select((F.col("a") + (F.coalesce("b", "a") - F.col("a")) * part).alias(name))


def grouped_quantiles(df: DataFrame, groups: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(groups..., n, and a column for each name in qs): exact quantiles of each group, between two rows in proportion.

    Values are ranked in their groups by ranges (operators/ranks.py), and of each group only the rows at the wanted ranks,
    two a quantile, are joined; so a group may hold any share of the rows. Nulls and NaN do not count; a group without
    other values has no row. Null groups are one group.
    """
    x = df.select(*groups, F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    placed = ranked(x, groups, ["_x"], "_rank")
    sizes = placed.groupBy(*groups).agg(F.max("_rank").alias("n"))
    ends = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("place")) for name, q in qs.items()])
    wanted = sizes.select("n", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.inline(ends))
    wanted = wanted.withColumn("_rank", F.explode(F.array(F.floor("place") + 1, F.ceil("place") + 1))).withColumn("share", F.when(F.col("_rank") == F.floor("place") + 1, 1 - (F.col("place") - F.floor("place"))).otherwise(F.col("place") - F.floor("place"))).distinct()
    same = placed["_rank"] == wanted["_rank"]
    for i, g in enumerate(groups):
        same = same & placed[g].eqNullSafe(wanted[f"_g{i}"])
    hit = placed.join(wanted, same).select(*[placed[g] for g in groups], "n", "name", (F.col("_x") * F.col("share")).alias("part"))
    return hit.groupBy(*groups, "n").agg(*[F.sum(F.when(F.col("name") == name, F.col("part"))).alias(name) for name in qs])


def fit_p99(df: DataFrame, column: str, train: Column) -> DataFrame:
    """One row: the exact 99th percentile over training rows, 1 if it is not positive."""
    p = quantile(df.filter(train), F.col(column), 0.99, "p99")
    return p.select(F.when(F.coalesce("p99", F.lit(0.0)) <= 0, 1.0).otherwise(F.col("p99")).alias("p99"))


def fit_positions(df: DataFrame, vector: str, train: Column) -> DataFrame:
    """(pos, mean, std) of every position of an array column over training rows."""
    parts = df.filter(train).select(F.posexplode(vector).alias("pos", "x"))
    fitted = parts.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
    return fitted.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def masked(vector: Column, positions: list[int]) -> Column:
    """The vector with the named positions as 0: feature ablation."""
    hidden = F.array(*[F.lit(p) for p in positions])
    return F.transform(vector, lambda x, i: F.when(F.array_contains(hidden, i), F.lit(0).cast("float")).otherwise(x))
