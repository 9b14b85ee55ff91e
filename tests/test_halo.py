"""Windows in ranges with a halo against Spark's own windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators import halo

SCHEMA = "k string, j int, at int, id int, x int, y double, z double, port int"


def table(spark, n, keys, seed=1):
    rnd = random.Random(seed)
    some = lambda v: None if rnd.random() < 0.1 else v
    rows = [(some(rnd.choice(keys)), rnd.randrange(2), rnd.randrange(n // 3 + 1), i, some(rnd.randrange(-5, 9)), some(rnd.random()), some(float(rnd.randrange(4))), some(rnd.randrange(6))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def both(df, keys, rows, ranges):
    parts = {"sums": {"sx": F.col("x"), "sy": F.col("y")}, "means": {"my": F.col("y"), "mz": F.col("z")}, "distinct": {"d": F.nullif("port", F.lit(0)), "dz": F.col("z")}}
    got = halo.trailing_features(df, keys, ["at", "id"], rows, **parts, columns=["id"], ranges=ranges)
    w = Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(-rows, -1)
    want = df.select(
        "id", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in parts["sums"].items()], *[F.coalesce(F.avg(c).over(w), F.lit(0.0)).alias(n) for n, c in parts["means"].items()],
        *[F.size(F.collect_set(c).over(w)).cast("bigint").alias(n) for n, c in parts["distinct"].items()],
    )
    order = lambda t: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()])
    assert got.dtypes == want.dtypes
    return order(got), order(want)


@pytest.mark.parametrize(("n", "keys", "rows", "ranges"), [
    (3000, ["one"], 7, 9), (3000, ["one"], 375, 5), (400, ["one"], 100, 40), (3000, ["one", "one", "one", "b", "c"], 20, 8), (2000, [f"k{i}" for i in range(700)], 5, 6), (1, ["one"], 3, 2), (0, ["one"], 3, 2),
])
def test_ranges_give_what_windows_give(spark, n, keys, rows, ranges):
    got, want = both(table(spark, n, keys), ["k"], rows, ranges)
    assert got == want and len(got) == n


def test_batches_smaller_than_the_window(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        for rows, ranges in ((1, 3), (10, 4), (50, 2)):
            got, want = both(table(spark, 300, ["a", "a", "b"], rows), ["k", "j"], rows, ranges)
            assert got == want
    finally:
        spark.conf.set(size, old)


def test_one_key_is_many_tasks(spark):
    """All rows have one key: the first pass is dealt evenly, the second one reads no more than two windows a range."""
    n, rows, ranges = 40_000, 30, 16
    df = spark.range(n).select(F.lit("global").alias("k"), F.col("id").alias("at"), F.lit(1).alias("x"))
    dealt = df.repartitionByRange(ranges, "k", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == ranges and max(r["count"] for r in dealt) < 2 * n / ranges
    got = halo.trailing_features(df, ["k"], ["at"], rows, {"s": F.col("x")}, {}, {}, ranges=ranges)
    assert got.filter(F.col("s") != F.least(F.col("at"), F.lit(rows))).count() == 0 and got.count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_lacks" in plan


def test_results_replace_columns(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7)], "k int, at int, s int")
    got = halo.trailing_features(df, ["k"], ["at"], 2, {"s": F.col("s")}, {}, {}).orderBy("at").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0), (1, 2, 5), (1, 3, 11)]
