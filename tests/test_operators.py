"""Operators against plain Python, on inputs that the driver's tables do not hold."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import neighbours as N
from flowlens.operators import ordered as O



def test_class_margins_beyond_the_nearest(spark):
    rnd = random.Random(4)

    def near(angle, k):
        return [math.cos(angle) + 1e-4 * k, math.sin(angle), rnd.random() / 50]

    rows = [(k, near(0.1, k), "a") for k in range(120)]  # more of one class than the 50 nearest
    rows += [(200 + k, near(1.2, k), "b") for k in range(3)] + [(300, near(0.5, 1), None), (301, near(2.0, 1), "c")]
    t = spark.createDataFrame(rows, "id bigint, v array<double>, klass string").repartition(3)

    def distance(x, y):
        return 1 - sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y)

    for block_rows in (20_000, 30):
        got = {r.query_id: r for r in N.class_margins(t.filter("id % 2 = 0 or id = 301"), t, "id", "v", "klass", block_rows).collect()}
        assert set(got) == {r[0] for r in rows if r[0] % 2 == 0 or r[0] == 301}
        for i, v, k in rows:
            if i in got:
                own = min((distance(v, w) for j, w, c in rows if j != i and k and c == k), default=None)
                other = min((distance(v, w) for j, w, c in rows if k and c and c != k), default=None)
                for a, b in ((got[i].own, own), (got[i].other, other), (got[i].margin, None if own is None or other is None else other - own)):
                    assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), i


def test_bootstrap_draws(spark):
    """Counts of a draw are multinomial: sums, means and spreads of many draws, small and large cells; and the scores from them."""
    rows = [("a", "a", 700), ("a", "b", 40), ("b", "a", 3), ("b", "b", 250), ("c", "a", 1), ("c", "c", 6)]
    n, total = np.array([r[2] for r in rows]), 1000
    counts = F.array(*[F.lit(int(x)).cast("bigint") for x in n])
    u = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: M.uniform(1, F.col("id"), i))
    drawn = np.array([r.k for r in spark.range(4000).select(M.multinomial_counts(counts, u).alias("k")).collect()])
    assert (drawn.sum(axis=1) == total).all() and (drawn >= 0).all()
    p = n / total
    spread = np.sqrt(total * p * (1 - p))
    assert (np.abs(drawn.mean(axis=0) - n) < 4 * spread / np.sqrt(4000)).all()
    assert (np.abs(drawn.std(axis=0) / spread - 1) < 0.06).all()
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 3])[0, 1] + np.sqrt(p[0] * p[3] / (1 - p[0]) / (1 - p[3]))) < 0.05
    assert abs((drawn[:, 4] == 0).mean() - 0.999**1000) < 0.03  # a cell of one row is absent from a third of the draws


def test_binomial_quantiles(spark):
    """Against cumulative probabilities added up in Python: exact below 100 expected, within a hundredth of the spread above."""
    cases = [(n, p, u) for n in (0, 1, 9, 150, 5000, 2_000_000) for p in (0.0, 1e-5, 0.02, 0.3, 0.5, 0.9, 0.9999, 1.0) for u in (1e-6, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-6)]
    got = spark.createDataFrame(cases, "n bigint, p double, u double").select("*", M.binomial_count(F.col("n"), F.col("p"), F.col("u")).alias("k")).collect()
    for r in got:
        q, v = (1 - r.p, 1 - r.u) if r.p > 0.5 else (r.p, r.u)
        k = r.n - r.k if r.p > 0.5 else r.k
        assert 0 <= k <= r.n
        mean, spread = r.n * q, math.sqrt(r.n * q * (1 - q))
        low = max(0, int(mean - 9 * spread - 9))
        log = lambda j: math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + (j * math.log(q) if q else 0.0 if not j else -math.inf) + (r.n - j) * math.log1p(-q)  # noqa: E731, B023
        if q >= 1 or not r.n:
            continue
        total, want = 0.0, low
        for j in range(low, r.n + 1):
            total, want = total + math.exp(log(j)), j
            if total >= v - (1e-12 if r.n <= 5000 else 1e-7):  # sums of many small numbers in Python are no better
                break
        assert abs(k - want) <= (0 if mean < 100 and r.n <= 5000 else 2 if mean < 100 else 1 + 0.03 * spread), tuple(r)


def test_bootstrap_is_independent_of_rows(spark):
    """A table of twelve thousand million rows costs what one of twelve does."""
    t = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    cells = M.confusion(t, "t", "p").withColumn("n", F.lit(4_000_000_000))
    real = M.confusion
    M.confusion = lambda *a: cells
    try:
        got = M.bootstrap_macro_f1(t, "t", "p", 200, 42)
        [r] = got.collect()
    finally:
        M.confusion = real
    assert 0.666 < r.low < r.middle < r.high < 0.667
    [none] = M.bootstrap_macro_f1(t.filter("false"), "t", "p", 200, 42).collect()
    assert none.low is None


def walk(times, idle, active):
    flows = []
    for t in sorted(times):
        if not flows or t >= min(flows[-1][0] + active, flows[-1][1] + idle):
            flows.append([t, t, 0])
        flows[-1][1] = t
        flows[-1][2] += 1
    return [tuple(f) for f in flows]


def test_timeout_flows(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), rnd.randrange(4000)) for _ in range(1500)] + [("a", 1, None), ("z", 0, None), ("y", 9, 5), ("y", 9, 5)]
    t = spark.createDataFrame(rows, "k string, j int, s long").selectExpr("k", "j", "timestamp_seconds(s) as ts").repartition(3)
    want = {(k, j, *f) for k, j in {r[:2] for r in rows} for f in walk([s for a, b, s in rows if (a, b) == (k, j) and s is not None], 20, 50)}
    for size in (10_000, 7, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [tuple(r) for r in O.timeout_flows(t, ["k", "j"], "ts", 20.0, 50.0).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and set(got) == want


def test_timeout_flows_one_long_period(spark):
    """One key, no idle gap: 150,000 flows in one busy period, which no task may hold as one value."""
    t = spark.range(300_000).selectExpr("1 as k", "timestamp_seconds(id) as ts")
    flows = O.timeout_flows(t, ["k"], "ts", 20.0, 2.0)
    assert "collect_list" not in flows._jdf.queryExecution().toString()
    assert flows.groupBy("n_events").count().collect() == [(2, 150_000)]
