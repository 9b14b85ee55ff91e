"""Searches in which every row asks, not a part of the ids."""

import duckdb
import numpy as np
import pytest

from flowlens.operators import neighbours as N
from flowlens.plans import catalog, tables  # noqa: F401

IDS = [*range(1, 45), 60, 61, None, 87]


def write(spark, folder):
    """Vectors about three centres, with copies; few ids are divisible by 20, one is null."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3, 6))[rng.integers(0, 3, len(IDS))] + 0.2 * rng.normal(size=(len(IDS), 6))
    v[7] = v[9] = v[30]
    rows = [(i, [float(x) for x in w], n % 4 if n % 9 else None) for n, (i, w) in enumerate(zip(IDS, v, strict=True))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def rounded(rows):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def both(spark, folder, name):
    """Rows of the query and of its SQL, columns in order of their names."""
    df = catalog.queries()[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    columns = ", ".join(sorted(df.columns))
    want = duck.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return rounded(tuple(r) for r in df.select(*sorted(df.columns)).collect()), rounded(want)


def test_knn_cosine_topk(spark, tmp_path):
    got, want = both(spark, write(spark, tmp_path), "knn_cosine_topk")
    assert got == want and len(got) == 5 * (len(IDS) - 1) and {r[1] for r in got} == {i for i in IDS if i is not None}


def test_neighbour_summaries(spark, tmp_path):
    """All rows count, those without a label too; how often classes agree is known of pairs with both labels only."""
    got, want = both(spark, write(spark, tmp_path), "neighbour_summaries")
    counted = catalog.queries()["neighbour_summaries"](spark, str(tmp_path)).groupBy("level").sum("count").collect()
    assert got == want and {tuple(r) for r in counted} == {(level, len(IDS) - 1) for level in ("all", "class", "subtype")}


def test_nn_agreement_rates(spark, tmp_path):
    """All rows count; those without a label are a group, too."""
    got, want = both(spark, write(spark, tmp_path), "nn_agreement_rates")
    assert got == want and len(got) == 5 and sum(r[2] for r in got) == 5 * (len(IDS) - 1)


@pytest.mark.parametrize("k", [1, 5, 700])
def test_single_precision_decides_nothing(spark, k):
    """Neighbours that single precision cannot tell apart, copies across tiles, rows of no length: as by full distances."""
    rng = np.random.default_rng(k)
    v = rng.normal(size=(4, 40))[rng.integers(0, 4, 6000)] + 1e-6 * rng.normal(size=(6000, 40))
    v[rng.integers(0, 6000, 1500)] = v[11]
    v[20:30] = 0
    unit = v / np.where((n := np.sqrt((v * v).sum(axis=1))) == 0, 1, n)[:, None]
    refs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>").repartition(3)
    got = {}
    for r in N.knn(refs.filter("id % 200 = 11 or id = 20"), refs, "id", "v", k, 4500).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.ref_id
    assert len(got) == 31
    for q, near in got.items():
        d = np.round(1 - unit[q] @ unit.T, 9)
        assert [near[i + 1] for i in range(k)] == [int(i) for i in np.lexsort((np.arange(6000), d)) if i != q][:k]
