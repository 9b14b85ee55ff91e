"""Pools against their manifests, and batches that are stopped and taken up again."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import scaling
from flowlens.sources import manifests as M


def pool(spark, path):
    spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("klass"), F.concat(F.lit("v"), "id").alias("v")).repartition(6).write.parquet(path)
    return sorted(f for f in os.listdir(path) if f.endswith(".parquet"))


def test_digest_is_of_the_rows(spark):
    rows = [(1, "a", None), (2, "b", "x"), (2, "b", "x"), (3, "", "y")]
    d = lambda r, cols="i int, s string, t string": spark.createDataFrame(r, cols).repartition(3).agg(M.digest([c.split()[0] for c in cols.split(", ")]).alias("d")).first().d
    one = d(rows)
    assert one == d(rows[::-1]) == d([(t, i, s) for i, s, t in rows], "t string, i int, s string")
    assert len({one, d(rows[:3]), d([*rows, rows[0]]), d([(1, "a", ""), *rows[1:]]), d([(1, None, "a"), *rows[1:]]), d([])}) == 6


def test_each_fault_is_named(spark, tmp_path):
    path = str(tmp_path / "pool")
    files = pool(spark, path)
    body = M.write_manifest(spark, path, "klass", run="r1")
    assert (body["files"], body["rows"], body["per_class"]) == (6, 300, {"0": 100, "1": 100, "2": 100}) and M.read_manifest(spark, path) == body
    found, classes = M.reconcile(spark, path, "klass")
    assert {r.file: r.status for r in found.collect()} == dict.fromkeys(files, "same")
    lost, broken, changed, whole = files[:4]
    n = {f: spark.read.parquet(f"{path}/{f}").count() for f in files}
    os.remove(f"{path}/{lost}")
    for side in (broken, changed):
        crc = f"{path}/.{side}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    open(f"{path}/{broken}", "wb").write(b"PAR1 no parquet at all")
    spark.read.parquet(f"{path}/{whole}").withColumn("v", F.upper("v")).coalesce(1).write.parquet(str(tmp_path / "other"))
    [part] = [f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet")]
    os.replace(tmp_path / "other" / part, f"{path}/{changed}")
    spark.range(7).select("id", F.lit("9").alias("klass"), F.lit("new").alias("v")).coalesce(1).write.mode("append").parquet(path)
    [extra] = set(f for f in os.listdir(path) if f.endswith(".parquet")) - set(files)
    found, classes = M.reconcile(spark, path, "klass")
    got = {r.file: (r.status, r.rows_then, r.rows_now) for r in found.collect()}
    assert got == {
        lost: ("missing", n[lost], None), broken: ("unreadable", n[broken], None), changed: ("changed", n[changed], n[whole]), extra: ("extra", None, 7),
        **{f: ("same", n[f], n[f]) for f in files[3:]},
    }
    counts = {r.class_name: (r.rows_then, r.rows_now) for r in classes.collect()}
    assert counts["9"] == (0, 7) and sum(a for a, _ in counts.values()) == 300
    again = M.write_manifest(spark, path, "klass", run="r2")
    assert again["content_hash"] != body["content_hash"] and M.read_manifest(spark, path)["run"] == "r2"
    assert not [f for f in os.listdir(path) if f.endswith(".tmp")]
    text = json.dumps({**again, "rows": 1})
    M.replace_text(spark, f"{path}/{M.MANIFEST}", text)
    with pytest.raises(ValueError, match="hash"):
        M.read_manifest(spark, path)
    with pytest.raises(FileNotFoundError):
        M.read_manifest(spark, str(tmp_path / "other"))


def test_same_content_same_hash(spark, tmp_path):
    a, b = str(tmp_path / "a" / "pool"), str(tmp_path / "b" / "pool")
    df = spark.range(50).select("id", F.lit("k").alias("klass"))
    for path in (a, b):
        df.coalesce(1).write.parquet(path)
    content = []
    for path in (a, b):
        [f] = [f for f in os.listdir(path) if f.endswith(".parquet")]
        os.rename(f"{path}/{f}", f"{path}/one.parquet")
        content.append(M.write_manifest(spark, path, "klass")["manifest_hash"])
    assert content[0] == content[1]


class Stopped(Exception):
    pass


def test_batches_are_taken_up_again(spark, tmp_path):
    path = str(tmp_path)
    work = spark.createDataFrame([(k, 10.0 if k % 7 else 60.0) for k in range(40)], "id int, cost double").repartition(4)
    calls = []

    def step(batch):
        calls.append(sorted(int(r.id) for r in batch.collect()))
        i = F.col("id").cast("int")
        outcome = F.when(i % 5 == 4, "deferred").when(i % 5 == 3, "rejected").otherwise("done")
        return batch.filter(i % 5 < 3).select("id", (i * 2).alias("value")), batch.filter(i % 10 != 9).select("id", outcome.alias("outcome"))

    real, stops = M._rename, iter([3, 6])
    at = [next(stops)]

    def broken(spark, old, new):
        at[0] -= 1
        if at[0] == 0:
            at[0] = next(stops, 10**6)
            raise Stopped
        real(spark, old, new)

    M._rename = broken
    try:
        for _ in range(2):
            with pytest.raises(Stopped):
                M.run_batches(work, path, step, 50.0, order=["cost", "id"])
        one = M.run_batches(work, path, step, 50.0, most_batches=1, order=["cost", "id"])
        assert one["stop_reason"] == "most_batches" and one["batches"] == 1
        end = M.run_batches(work, path, step, 50.0, order=["cost", "id"])
    finally:
        M._rename = real
    assert end["stop_reason"] == "only_deferred_left" and end["health"] == {"done": 24, "rejected": 8, "deferred": 8}
    rows = Counter((r.id, r.value) for r in spark.read.parquet(f"{path}/pool").collect())
    assert rows == Counter({(str(k), 2 * k): 1 for k in range(40) if k % 5 < 3})  # once each
    assert all(sum(60 if k % 7 == 0 else 10 for k in c) <= 50 or len(c) == 1 for c in calls)
    more = work.union(spark.createDataFrame([(100, 1.0), (101, 1.0)], work.schema))
    M.run_batches(more, path, step, 50.0, order=["cost", "id"])
    assert {r.id for r in M.registry(spark, path).filter("outcome = 'done'").collect()} >= {"100", "101"}


def test_all_done(spark, tmp_path):
    work = spark.createDataFrame([(k, 1.0) for k in range(5)], "id int, cost double")
    got = M.run_batches(work, str(tmp_path), lambda b: (b.select("id"), b.select("id", F.lit("done").alias("outcome"))), 2.0)
    assert got == {"stop_reason": "completed", "batches": 3, "health": {"done": 5}}
    assert M.run_batches(work, str(tmp_path), None, 2.0) == {"stop_reason": "completed", "batches": 0, "health": {"done": 5}}


def test_grouped_quantiles(spark):
    import numpy as np

    rows = [("a", float(v)) for v in (5, 1, 1, 8, 2, 9, 9, 4)] + [("b", 3.0), (None, 7.0), (None, 6.0), ("a", None), ("c", None), ("b", float("nan"))]
    qs = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.g: (r.n, [r[q] for q in qs]) for r in scaling.grouped_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], "x", qs).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g][0] == len(values) and np.allclose(got[g][1], np.quantile(values, list(qs.values())))
