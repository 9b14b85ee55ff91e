"""Stateful streams against the batch operators over the same rows."""

from pyspark.sql import functions as F

from flowlens.operators import halo
from flowlens.operators import ordered as O
from flowlens.streaming import stateful as S

START = 1_000_000
SCHEMA = "id bigint, k string, at bigint, ts timestamp, flag int, port int"


def rows(spark):
    times = {"a": [0, 100, 200, 300, 420, 421, 3000], "b": [k * 100 for k in range(37)], "c": [5, 5, 5]}
    flat = [(k, t) for k, ts in times.items() for t in ts] + [("z", 10_000)]
    # Not from the epoch on: that is where watermarks begin, and they drop what is not later.
    data = [(i, k, START + t, i % 3, (i * 7) % 4) for i, (k, t) in enumerate(flat)]
    df = spark.createDataFrame(data, "id bigint, k string, at bigint, flag int, port int")
    return df.withColumn("ts", F.timestamp_seconds("at")).select("id", "k", "at", "ts", "flag", "port")


def streamed(spark, df, path):
    """The rows as a stream of two files, one a micro-batch, in order of time."""
    early = F.col("at") < START + 1500
    for part in (early, ~early):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def test_flows(spark, tmp_path):
    df = rows(spark)
    got = S.drained(S.flows(streamed(spark, df, tmp_path), ["k"], "ts", 120, 1800), str(tmp_path / "out"))
    seconds = [(F.unix_timestamp(c) - START).alias(c) for c in ("first_seen", "last_seen")]
    got = sorted(tuple(r) for r in got.select("k", *seconds, "n_events").collect())
    want = O.timeout_flows(df, ["k"], "ts", 120, 1800).filter("k <> 'z'")
    assert got == sorted((r.k, int(r.first_seen) - START, int(r.last_seen) - START, r.n_events) for r in want.collect())
    assert ("b", 0, 1700, 18) in got and ("b", 1800, 3500, 18) in got and ("a", 420, 421, 2) in got


def test_trailing(spark, tmp_path):
    df = rows(spark)
    stream = S.trailing_features(streamed(spark, df, tmp_path), ["k"], "id", "ts", 5, ["flag"], ["port"])
    got = sorted(tuple(r) for r in S.drained(stream, str(tmp_path / "out")).collect())
    want = halo.trailing_features(df, ["k"], ["ts", "id"], 5, {"s": F.col("flag")}, {}, {"d": F.expr("nullif(port, 0)")})
    assert got == sorted((r.id, float(r.s), r.d) for r in want.collect())
