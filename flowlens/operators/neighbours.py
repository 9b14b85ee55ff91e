"""Nearest neighbours by cosine distance, exact, as blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scaling import grouped_quantiles
from flowlens.scratch import cut

_FOUND = "query_id bigint, ref_id bigint, distance double"
_TILE = 256, 4096  # queries and references whose distances are worked out at a time


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    n = np.sqrt((m * m).sum(axis=1))
    m /= np.where(n == 0, 1, n)[:, None]
    return m


def _vectors(rows: pa.Table) -> np.ndarray:
    """The column v as a matrix, straight from Arrow's values: no Python object a row."""
    column = rows.column("v").combine_chunks()
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("vectors must not be null and must have one length")
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(n_left: int, n_right: int, first: int = _TILE[1]) -> Iterator[tuple[slice, list[slice]]]:
    """Batches of the left side, each with all batches of the right side: distances are worked out a tile at a time.

    A task needs a few arrays of one tile beside the vectors of its two blocks, however large these are. first is the
    size of the right side's first batch.
    """
    right = [slice(*ends) for ends in pairwise([0, *range(min(first, n_right), n_right, _TILE[1]), n_right])]
    for at in range(0, n_left, _TILE[0]):
        yield slice(at, min(at + _TILE[0], n_left)), right


def _first(k: int, row: np.ndarray, column: np.ndarray, rounded: np.ndarray) -> np.ndarray:
    """Which entries are the first k of their row by rounded distance, then column, in that order."""
    order = np.lexsort((column, rounded, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def _nearer(k: int, asked: tuple, given: tuple, likely: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, column, rounded, distance) of those pairs of a tile that are nearer than their row's limit, in full precision.

    asked and given are (ids, vectors), asked's vectors of unit length; likely says which pairs can be nearer. Where these
    are few they are worked out one by one, else all pairs are at once and each row's first k, with ties, are left.
    """
    (ids, vectors), (ref_ids, refs) = asked, given
    if np.count_nonzero(likely) * 128 < likely.size:
        row, column = np.divmod(np.flatnonzero(likely), likely.shape[1])
        distance = 1 - np.einsum("ij,ij->i", vectors[row], _unit(refs[column]))
        rounded = np.round(distance, 9)
        keep = (rounded < limit[row]) & (ids[row] != ref_ids[column])
        return row[keep], column[keep], rounded[keep], distance[keep]
    distance = 1 - vectors @ _unit(refs).T
    rounded = np.round(distance, 9)
    rounded[ids[:, None] == ref_ids[None, :]] = np.inf
    n = min(k, rounded.shape[1])
    most = np.partition(rounded, n - 1, axis=1)[:, n - 1]
    row, column = np.nonzero((rounded <= most[:, None]) & (rounded < limit[:, None]))
    return row, column, rounded[row, column], distance[row, column]


def _search(k: int):
    """The k nearest of a block of references for each of a block of queries, ties at the limit by id.

    All distances are worked out in single precision. Those that may be below a query's k-th so far, by what that precision
    can be off, are worked out again in double precision, which decides.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            right = right.sort_by("id")  # of equal distances the first has the smaller id
            ids, ref_ids = (side.column("id").to_numpy() for side in (left, right))
            asked, given = _vectors(left), _vectors(right)
            coarse = np.empty(given.shape, np.float32)
            for _, tiles in _tiles(1, len(ref_ids)):
                for tile in tiles:
                    coarse[tile] = _unit(given[tile])
            # Half a step of rounding below the limit is no nearer. A sum of products is off by half of 2**-23 a term at most.
            slack = 4e-10 - (given.shape[1] + 8) * 2.0**-23
            for part, tiles in _tiles(len(ids), len(ref_ids), min(max(512, 256 * k), _TILE[1])):
                vectors = _unit(asked[part])
                rough, limit = vectors.astype(np.float32), np.full(len(vectors), np.inf)
                best = np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0)
                for tile in tiles:
                    likely = rough @ coarse[tile].T > (1 - limit + slack).astype(np.float32)[:, None]
                    row, column, rounded, distance = _nearer(k, (ids[part], vectors), (ref_ids[tile], given[tile]), likely, limit)
                    if len(row):
                        found = (row, column + tile.start, rounded, distance)
                        row, column, rounded, distance = (np.concatenate(x) for x in zip(best, found, strict=True))
                        keep = _first(k, row, column, rounded)
                        best = row[keep], column[keep], rounded[keep], distance[keep]
                        n = np.bincount(best[0], minlength=len(limit))
                        limit[n == k] = best[2][np.cumsum(n)[n == k] - 1]
                row, column, _, distance = best
                parts.append((ids[part][row], ref_ids[column], distance))
        query_id, ref_id, distance = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [], [])
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "ref_id": pa.array(ref_id, pa.int64()), "distance": pa.array(distance, pa.float64())})

    return run


def _blocked(queries: DataFrame, refs: DataFrame, id_col: str, columns: list[Column], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks of about block_rows rows, each with a copy for every block of the other side (ask, block).

    Rows without an id are left out, as a row is no neighbour of itself.
    """
    queries, refs = (df.filter(F.col(id_col).isNotNull()) for df in (queries, refs))
    asked_blocks, blocks = (max(1, -(-df.count() // block_rows)) for df in (queries, refs))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def own_block(n):
        return F.pmod(F.xxhash64(id_col), F.lit(n).cast("bigint"))

    asked = queries.select(*columns, own_block(asked_blocks).alias("ask"), every(blocks).alias("block"))
    return asked, refs.select(*columns, every(asked_blocks).alias("ask"), own_block(blocks).alias("block"))


def knn(queries: DataFrame, refs: DataFrame, id_col: str, vector: str, k: int, block_rows: int = 20_000) -> DataFrame:
    """(query_id, ref_id, distance, rank) of the k nearest references other than the query itself; ties go to the smaller id.

    Queries and references are dealt into blocks of about block_rows rows; each pair of blocks is one task's group, which
    multiplies its matrices in tiles and returns k rows a query, which one window then ranks. No side is collected; the
    work is queries times references, as an exact search needs, in blocks of bounded memory.
    """
    asked, dealt = _blocked(queries, refs, id_col, [F.col(id_col).alias("id"), F.col(vector).alias("v")], block_rows)

    return _nearest(asked.groupBy("ask", "block").cogroup(dealt.groupBy("ask", "block")).applyInArrow(_search(k), _FOUND), k)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fit_pivots(refs: DataFrame, id_col: str, vector: str, pivots: int, sample: int = 4096) -> np.ndarray:
    """Unit vectors far from each other: of a sample in hash order, each the one that is farthest from those before it.

    The sample has a fixed size (sample rows); pivots only say where cells lie, every row is assigned and searched.
    """
    rows = refs.orderBy(F.xxhash64(id_col), id_col).select(F.col(vector).alias("v")).limit(sample).toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    m = _unit(np.stack(rows["v"].to_numpy()))
    chosen, far = [0], np.linalg.norm(m - m[0], axis=1)
    while len(chosen) < min(pivots, len(m)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(m - m[chosen[-1]], axis=1))
    return m[chosen]


def _cells(pivots, most: bool):
    """Rows (id, v) with their cell and their distance to its pivot; for queries also the distances to all pivots."""

    def run(batches):
        p = pivots.value
        for rows in batches:
            if not len(rows):
                continue
            m = _unit(np.stack(rows["v"].to_numpy()))
            d = np.sqrt(np.maximum(0, (m * m).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * m @ p.T))
            cell = d.argmin(axis=1)
            out = pd.DataFrame({"id": rows["id"], "v": rows["v"], "cell": cell.astype(np.int64), "far": d[np.arange(len(m)), cell], "zero": ~m.any(axis=1)})
            yield out.assign(all=list(d)) if most else out

    return run


def knn_pruned(queries: DataFrame, refs: DataFrame, id_col: str, vector: str, k: int, pivots: int = 64, block_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(neighbours, work): what knn() returns, by searching only cells that can hold one of the k nearest; all ties included.

    References belong to the cell of their nearest pivot. A query first searches its own cell; the k-th distance found bounds
    what it still needs: by the triangle inequality of unit vectors (the square of their distance is twice the cosine
    distance) a cell whose pivot is farther than that bound and the cell's radius together holds nothing nearer. Cells are
    dealt to blocks of about block_rows rows. References and queries of length 0 have distance 1 to all; such queries search
    all cells, and such references are searched by all queries. Pivots, radii and sizes of cells are small tables of fixed
    size, sent to all tasks. work(pairs, all_pairs) says how many distances were worked out.
    """
    spark = refs.sparkSession
    found = fit_pivots(refs, id_col, vector, pivots)
    if not len(found):
        empty = spark.createDataFrame([], f"{_FOUND}, rank int")
        return empty, spark.createDataFrame([(0, 0)], "pairs bigint, all_pairs bigint")
    shared = spark.sparkContext.broadcast(found)
    kind = refs.schema[vector].dataType.simpleString()
    own = [F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")]
    fields = f"id bigint, v {kind}, cell bigint, far double, zero boolean"
    placed = cut(refs.select(*own).mapInPandas(_cells(shared, False), fields), "cells").withColumn("cell", F.when(F.col("zero"), F.lit(-1)).otherwise(F.col("cell")))
    asked = cut(queries.select(*own).mapInPandas(_cells(shared, True), f"{fields}, all array<double>"), "asked")
    cells = {r.cell: (r.radius, r.n) for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # pivots + 1 rows
    blocks = {c: -(-n // block_rows) for c, (_, n) in cells.items()}
    per_cell = spark.createDataFrame([(int(c), float(r or 0.0), int(n), int(blocks[c])) for c, (r, n) in cells.items()], "cell bigint, radius double, n bigint, blocks bigint")
    sides = placed.join(F.broadcast(per_cell.select("cell", "blocks")), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))

    def searched(rows: DataFrame) -> DataFrame:
        left = rows.join(F.broadcast(per_cell.select("cell", "blocks")), "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        return left.groupBy("cell", "block").cogroup(sides.groupBy("cell", "block")).applyInArrow(_search(k), _FOUND)

    first = asked.select("id", "v", "cell").unionByName(asked.select("id", "v", F.lit(-1).cast("bigint").alias("cell")))
    near = cut(_nearest(searched(first), k).drop("rank"), "near")
    bounds = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
    # A little more than the bound, as distances are rounded to nine places for ties and worked out in another way here.
    bound = F.when(F.coalesce("n", F.lit(0)) < k, float("inf")).otherwise(F.sqrt(2 * F.greatest(F.col("worst"), F.lit(0.0)) + 4e-9) + 1e-6)
    limited = asked.join(bounds, asked["id"] == bounds["query_id"], "left").withColumn("bound", F.when(F.col("zero"), float("inf")).otherwise(bound))
    radii = F.array(*[F.lit(float(cells[c][0])) if c in cells else F.lit(None).cast("double") for c in range(len(found))])
    wanted = F.filter(F.sequence(F.lit(0), F.lit(len(found) - 1)), lambda c: radii[c].isNotNull() & (c != F.col("cell")) & (F.element_at("all", c + 1) - radii[c] <= F.col("bound")))
    second = cut(limited.select("id", "v", F.explode(wanted).alias("cell")).withColumn("cell", F.col("cell").cast("bigint")), "second")
    out = _nearest(near.unionByName(searched(second)), k)
    visits = first.select("cell").unionByName(second.select("cell")).join(F.broadcast(per_cell), "cell")
    every = asked.agg(F.count(F.lit(1)).alias("q")).select((F.col("q") * sum(n for _, n in cells.values())).alias("all_pairs"))
    return out, visits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).crossJoin(every)  # one row each


def class_margins(queries: DataFrame, refs: DataFrame, id_col: str, vector: str, klass: str, block_rows: int = 20_000) -> DataFrame:
    """Per query: distance to the nearest reference of its class and of another, and their difference.

    All references other than the query itself are searched, however many are nearer. Queries and references are dealt
    into blocks; each pair of blocks is one task's group and returns one row a query, of which the least count. Where a
    side has no reference, or a class is null, the distance is null.
    """
    row = [F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(klass).alias("klass")]
    asked, dealt = _blocked(queries, refs, id_col, row, block_rows)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own, other = [], [], []
        if len(left) and len(right):
            classes = pa.chunked_array([*left.column("klass").chunks, *right.column("klass").chunks]).combine_chunks()
            codes = classes.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            q_class, r_class = codes[: len(left)], codes[len(left) :]
            q_ids, r_ids = (side.column("id").to_numpy() for side in (left, right))
            asked, matrix = _vectors(left), _unit(_vectors(right))
            for part, tiles in _tiles(len(q_ids), len(r_ids)):
                vectors, found = _unit(asked[part]), []
                for tile in tiles:
                    distance = 1 - vectors @ matrix[tile].T
                    others = q_ids[part, None] != r_ids[None, tile]
                    known = others & (q_class[part, None] >= 0) & (r_class[None, tile] >= 0)
                    same = q_class[part, None] == r_class[None, tile]
                    found.append((*(np.where(known & side, distance, np.inf).min(axis=1) for side in (same, ~same)), others.any(axis=1)))
                nearest, apart, there = zip(*found, strict=True)
                there = np.any(there, axis=0)
                for values, x in ((ids, q_ids[part]), (own, np.min(nearest, axis=0)), (other, np.min(apart, axis=0))):
                    values.append(x[there])
        query_id, own, other = (np.concatenate(x) if x else [] for x in (ids, own, other))
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "own": pa.array(own, pa.float64()), "other": pa.array(other, pa.float64())})

    found = asked.groupBy("ask", "block").cogroup(dealt.groupBy("ask", "block")).applyInArrow(run, "query_id bigint, own double, other double")
    least = found.groupBy("query_id").agg(*[F.min(F.when(F.col(c) < float("inf"), F.col(c))).alias(c) for c in ("own", "other")])
    return least.withColumn("margin", F.col("other") - F.col("own"))


# Percentiles of a summary, and distances below which neighbours are counted.
PERCENTILES = {"distance_min": 0.0, "distance_p01": 0.01, "distance_p05": 0.05, "distance_median": 0.5, "distance_p95": 0.95, "distance_max": 1.0}
NEAR = {"distance_le_0_001": 0.001, "distance_le_0_01": 0.01, "distance_le_0_05": 0.05}


def agreement(pairs: DataFrame, attributes: dict[str, str], side: str = "ref_") -> DataFrame:
    """pairs with same_<name> for each attribute: whether the query's column equals the reference's (side + column); nulls are equal."""
    return pairs.withColumns({f"same_{name}": F.col(c).eqNullSafe(F.col(f"{side}{c}")) for name, c in attributes.items()})


def neighbour_summary(pairs: DataFrame, distance: str, klass: str, subtype: str, same: list[str]) -> DataFrame:
    """One row for all pairs, for each class and for each subtype of a class (level: all, class, subtype).

    count, six exact percentiles of the distance, the share of pairs for which each column in same is true, and how many are
    within 0.001, 0.01 and 0.05. A level's other columns are null. Pairs are copied to the three levels once and go through
    one aggregation and one ranking (scaling.grouped_quantiles). No pairs give no rows.
    """
    none = F.lit(None).cast("string")
    k, s = F.col(klass).cast("string"), F.col(subtype).cast("string")
    levels = F.array(*[F.struct(F.lit(n).alias("level"), a.alias("class_name"), b.alias("subtype")) for n, a, b in (("all", none, none), ("class", k, none), ("subtype", k, s))])
    rows = pairs.select(F.col(distance).cast("double").alias("_distance"), *same, F.inline(levels))
    keys = ["level", "class_name", "subtype"]
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(F.col(c).cast("int")).alias(f"{c}_rate") for c in same], *[F.count_if(F.col("_distance") <= most).alias(n) for n, most in NEAR.items()]
    )
    ends = grouped_quantiles(rows, keys, "_distance", PERCENTILES).drop("n")
    on = F.lit(True)
    for c in keys:
        on = on & facts[c].eqNullSafe(ends[c])
    return facts.join(ends, on, "left").select(*[facts[c] for c in facts.columns], *PERCENTILES)
