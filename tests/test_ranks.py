"""Ranks in ranges against Spark's own row_number."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators import ordered, pools, ranks, sampling

SCHEMA = "k string, j int, at int, id int"


def table(spark, n, keys):
    rnd = random.Random(n)
    return spark.createDataFrame([(rnd.choice(keys), rnd.randrange(2), rnd.randrange(n // 2 + 1), i) for i in range(n)], SCHEMA)


@pytest.mark.parametrize(("n", "keys", "by", "ranges"), [
    (900, ["one"], ["k"], 7), (900, [None], ["k", "j"], 5), (900, ["a", "b", None], ["k"], 8), (900, [f"k{i}" for i in range(300)], ["k"], 6), (60, ["one"], ["k"], 30), (900, ["x"], [], 6), (1, ["x"], ["k"], 3), (0, ["x"], ["k"], 3),
])
def test_ranks_are_row_numbers(spark, n, keys, by, ranges):
    df = table(spark, n, keys)
    for order in (["at", "id"], [F.desc("at"), "id"]):
        got = sorted((r.id, r.rank) for r in ranks.ranked(df, by, order, ranges=ranges).collect())
        want = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by or [F.lit(1)]).orderBy(*order)))
        assert got == sorted((r.id, r["rank"]) for r in want.collect()) and len(got) == n


def test_small_batches_and_replaced_column(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        df = table(spark, 200, ["a", "a", "b"]).withColumn("rank", F.lit("old"))
        got = sorted((r.id, r.rank) for r in ranks.ranked(df, ["k"], ["at", "id"], ranges=5).collect())
    finally:
        spark.conf.set(size, old)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
    assert got == sorted((r.id, r["rank"]) for r in want.collect())


def test_one_class_is_many_tasks(spark):
    """A class of all rows: none of the ranges that are ranked holds more than twice its share."""
    n, parts = 60_000, 20
    df = spark.range(n).select(F.lit("c").alias("k"), "id")
    ranked = ranks.ranked(df, ["k"], ["id"], ranges=parts)
    assert ranked.filter(F.col("rank") != F.col("id") + 1).count() == 0
    [path] = {f.rsplit("/", 1)[0] for f in ranked.inputFiles()}
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_range").count().collect()]
    assert len(sizes) == parts and max(sizes) < 2 * n / parts


def test_first_per_key_beyond_a_thousand(spark):
    """Hashes bound what is dealt: of 40,000 rows of a class hardly more than the 1,500 asked for."""
    df = spark.range(40_000).select(F.when(F.col("id") % 40 == 0, "small").otherwise("large").alias("k"), "id").withColumn("h", sampling.score(7, "x", "id"))
    near, far = ranks.by_hash(df, ["k"], "h", 1500)
    counts = {r.k: r["count"] for r in near.groupBy("k").count().collect()}
    assert counts["small"] == 1000 and 1500 <= counts["large"] < 1600 and near.count() + far.count() == 40_000
    for hashed in ("h", None):
        got = ordered.first_per_key(df, ["k"], ["h", "id"], 1500, hashed)
        want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "id"))).filter("r <= 1500")
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_null_keys_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else "a", i // 2) for i in range(90)]
    df = spark.createDataFrame(rows, "c string, id int")
    split = Counter((r.c, r.split) for r in sampling.exact_split(df, ["c"], "id", {"test": 5, "val": 7}, "train", 3).collect())
    assert split == {(None, "test"): 5, (None, "val"): 7, (None, "train"): 18, ("a", "test"): 5, ("a", "val"): 7, ("a", "train"): 48}
    parts = Counter((r.fold_id, r.part) for r in pools.fold_parts(pools.folds(df, {"f": F.col("id") < 10, "g": F.lit(False)}), "c", "id", 4, 3).collect())
    assert parts == {("f", "test"): 20, ("f", "val"): 8, ("f", "train"): 62, ("g", "val"): 8, ("g", "train"): 82}


def test_permutation_is_of_the_whole_table(spark):
    df = spark.range(500).select("id", F.floor(F.col("id") / 100).alias("label"))
    got = sampling.permuted_labels(df, "id", "label", 5)
    rows = got.collect()
    assert Counter(r.shuffled_label for r in rows) == Counter({k: 100 for k in range(5)}) and len({r.id for r in rows}) == 500
    share = sum(r.label == r.shuffled_label for r in rows) / 500
    assert 0.1 < share < 0.3  # a fifth by chance
    cells = Counter((r.label, r.shuffled_label) for r in rows)
    assert len(cells) == 25  # every label reaches every part of the table
