"""Merged intervals on rows that the driver's tables do not hold."""

from datetime import datetime, timedelta

import duckdb

from flowlens.operators import audits as A
from flowlens.operators import ordered as O
from flowlens.plans import catalog, flows  # noqa: F401

DAY = datetime(2024, 1, 1)


def test_unknown_dates_as_in_sql(spark, tmp_path):
    """Orders without a date are in their customer's last interval; of customers with no other orders they are one row."""
    days = {1: [0, None, 10, 200], 2: [5], 3: [None], 4: [7, 300, None, 320], None: [3, 20, 100, None]}
    rows = [(10 * (k or 9) + i, k, None if day is None else DAY + timedelta(days=day)) for k, found in days.items() for i, day in enumerate(found)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in catalog.queries()["merged_intervals"](spark, str(tmp_path)).collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = duck.execute(catalog.oracle_sql()["merged_intervals"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 8


def test_equal_rows_are_one_interval(spark):
    rows = [(1, 0, 5)] * 4 + [(1, 5, 9)] * 3 + [(1, 10, 12)] * 2 + [(2, None, None)] * 3
    t = spark.createDataFrame(rows, "k bigint, a bigint, b bigint").repartition(3)
    got = {tuple(r) for r in O.merged_intervals(t, ["k"], "a", "b").collect()}
    assert got == {(1, 0, 9, 7), (1, 10, 12, 2), (2, None, None, 3)}


def test_windows_without_an_end_hold_nothing(spark):
    windows = spark.createDataFrame([(1, 0, 5), (1, None, 90), (1, 20, None), (2, None, 7), (1, 30, 31)], "k bigint, a bigint, b bigint")
    packets = spark.createDataFrame([(1, 3), (1, 10), (1, 25), (1, 31), (1, 60), (2, 6)], "k bigint, ts bigint")
    assert {tuple(r) for r in A.in_windows(packets, windows, ["k"], "ts", "a", "b").collect()} == {(1, 3), (1, 31)}
