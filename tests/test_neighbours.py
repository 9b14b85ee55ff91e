"""Pruned search against the full one, and how much of it is left out."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from flowlens.operators import neighbours as N


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<double>").repartition(3)


def rows(df):
    return sorted((r.query_id, r["rank"], r.ref_id, round(r.distance, 9)) for r in df.collect())


def clustered(rng, n, centres, spread, dims=12):
    at = rng.normal(size=(centres, dims))
    return at[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))


@pytest.mark.parametrize(("spread", "pivots", "block"), [(0.02, 16, 50), (0.3, 8, 30), (5.0, 4, 1000)])
def test_same_as_full_search(spark, spread, pivots, block):
    rng = np.random.default_rng(int(spread * 100))
    v = clustered(rng, 400, 12, spread)
    v[5] = v[6] = v[7]  # ties
    v[10] = 0  # no length
    refs, queries = table(spark, v), table(spark, [*v[:40], np.zeros(12)], 0)
    got, work = N.knn_pruned(queries, refs, "id", "v", 6, pivots, block)
    assert rows(got) == rows(N.knn(queries, refs, "id", "v", 6, 10_000))
    [w] = work.collect()
    assert w.all_pairs == 41 * 400 and 0 < w.pairs <= w.all_pairs


def test_clustered_data_leave_out_two_thirds(spark):
    v = clustered(np.random.default_rng(1), 3000, 20, 0.05)
    refs = table(spark, v)
    got, work = N.knn_pruned(refs.filter("id % 20 = 0"), refs, "id", "v", 5, 32)
    [w] = work.collect()
    assert w.pairs < w.all_pairs / 3
    assert rows(got) == rows(N.knn(refs.filter("id % 20 = 0"), refs, "id", "v", 5))


def test_fewer_references_than_neighbours(spark):
    refs = table(spark, np.eye(3))
    got, _ = N.knn_pruned(refs, refs, "id", "v", 5)
    assert rows(got) == rows(N.knn(refs, refs, "id", "v", 5)) and len(rows(got)) == 6
    none, work = N.knn_pruned(refs, refs.limit(0), "id", "v", 5)
    assert not none.collect() and work.first().pairs == 0


def test_tiles_are_joined(spark):
    """More references than a tile holds, with ties across tiles: the k first by distance and id."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (9000, 4)).astype(float)
    refs = table(spark, v)
    got = rows(N.knn(refs.filter("id % 300 = 7"), refs, "id", "v", 7))
    unit = v / np.where((n := np.sqrt((v * v).sum(axis=1))) == 0, 1, n)[:, None]
    want = []
    for q in range(7, 9000, 300):
        d = np.round(1 - unit[q] @ unit.T, 9)
        near = [int(i) for i in np.lexsort((np.arange(9000), d)) if i != q][:7]
        want += [(q, k + 1, i, d[i]) for k, i in enumerate(near)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])


def test_blocks_in_little_memory():
    """Full blocks of both sides: the distances of a tile are held, not those of a batch to all references."""
    m = np.random.default_rng(4).normal(size=(20_000, 64)).astype(np.float32)
    side = pa.table({"id": np.arange(20_000), "v": pa.FixedSizeListArray.from_arrays(m.ravel(), 64).cast(pa.list_(pa.float32()))})
    tracemalloc.start()
    out = N._search(5)(side.slice(0, 1000), side)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 5000 and peak < 100e6
