"""Sampling, splitting and balancing. Every order comes from a hash of seed, salt and key, never from a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import stable_hash
from flowlens.operators.ordered import first_per_key
from flowlens.operators.ranks import by_hash, ranked


def score(seed: int, salt: str, *key: str) -> Column:
    return stable_hash(F.lit(seed), F.lit(salt), *[F.col(k) for k in key])


def stable_take(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int, salt: str = "") -> DataFrame:
    """n rows of each key in hash order: a uniform sample that is the same on every run and engine."""
    return first_per_key(df.withColumn("_score", score(seed, salt, id_col)), keys, ["_score", id_col], n, "_score").drop("_score")


def stratified(df: DataFrame, stratum: str, id_col: str, total: int, seed: int) -> DataFrame:
    """Equal quotas of total for each stratum, the first ones (by name) taking one more until the rest is used up."""
    strata = df.select(stratum).distinct()
    numbered = strata.withColumns({"_k": F.row_number().over(Window.orderBy(stratum)), "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    quota = numbered.select(stratum, (F.floor(F.lit(total) / F.col("_n")) + (F.col("_k") <= F.lit(total) % F.col("_n")).cast("int")).alias("quota"))
    near, _ = by_hash(df.withColumn("_score", score(seed, "", id_col)), [stratum], "_score", total)
    return ranked(near, [stratum], ["_score", id_col], "_rank").join(quota, stratum).filter(F.col("_rank") <= F.col("quota")).drop("_rank", "_score")


def exact_split(df: DataFrame, keys: list[str], id_col: str, sizes: dict[str, int], rest: str, seed: int, strict: bool = True) -> DataFrame:
    """split: the named sizes in hash order within each key, everything else in rest.

    A key with fewer rows than the sizes ask for is an error, unless strict is off: then the later splits are short.
    """
    if strict:
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < sum(sizes.values())).limit(20).collect()
        if rows:
            raise ValueError(f"of {sum(sizes.values())} rows that the splits need, these keys have fewer: {[tuple(r) for r in rows]}")
    near, far = by_hash(df.withColumn("_score", score(seed, "split", id_col)), keys, "_score", sum(sizes.values()))
    out, upto = F.lit(rest), 0
    bounds = []
    for name, n in sizes.items():
        bounds.append((upto, upto + n, name))
        upto += n
    for low, high, name in reversed(bounds):
        out = F.when((F.col("_rank") > low) & (F.col("_rank") <= high), name).otherwise(out)
    placed = ranked(near, keys, ["_score", id_col], "_rank").withColumn("split", out).drop("_rank")
    return placed.unionByName(far.withColumn("split", F.lit(rest))).drop("_score")


def group_split(df: DataFrame, klass: str, group: str, share: float, seed: int) -> DataFrame:
    """(klass, group, size, split) with whole groups in one split.

    One group trains; of two the smaller is held out, as test or val by its hash; of more the smallest go to test until
    it has share of the rows, then to val likewise, while at least two and one groups are left for the later splits.
    """
    sizes = df.groupBy(klass, group).agg(F.count(F.lit(1)).alias("size"))
    h = score(seed, "group", klass, group)
    every, order = Window.partitionBy(klass), Window.partitionBy(klass).orderBy("size", "h")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("h", h).withColumns(
        {"k": F.row_number().over(order), "groups": F.count(F.lit(1)).over(every), "total": F.sum("size").over(every), "before": F.coalesce(F.sum("size").over(upto), F.lit(0))}
    )
    want = F.bround(F.col("total") * share)
    test = (F.col("groups") >= 3) & (F.col("k") <= F.col("groups") - 2) & ((F.col("k") == 1) | (F.col("before") < want))
    ranked = ranked.withColumn("test", test)
    used = ranked.withColumns({"test_groups": F.sum(F.col("test").cast("int")).over(every), "test_rows": F.sum(F.when(F.col("test"), F.col("size")).otherwise(0)).over(every)})
    k, before = F.col("k") - F.col("test_groups"), F.col("before") - F.col("test_rows")
    val = (F.col("groups") >= 3) & ~F.col("test") & (F.col("k") <= F.col("groups") - 1) & ((k == 1) | (before < want))
    odd = F.conv(F.substring("h", 1, 1), 16, 10).cast("int") % 2 == 1
    split = (
        F.when((F.col("groups") == 2) & (F.col("k") == 1), F.when(odd, "test").otherwise("val"))
        .when(F.col("test"), "test").when(val, "val").otherwise("train")
    )
    return used.select(klass, group, "size", split.alias("split"))


def balance(df: DataFrame, keys: list[str], id_col: str, target: int, seed: int) -> DataFrame:
    """target rows of each key: a hash-ordered part of larger ones; all rows of smaller ones, then copies in that order.

    copy counts the copies of a row from 0. Every row is repeated by its own number of copies, so no key is gathered.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    near, _ = by_hash(df.withColumn("_score", score(seed, "balance", id_col)), keys, "_score", target)
    placed = ranked(near, keys, ["_score", id_col], "_rank").drop("_score").join(sizes, keys)
    copies = F.floor((F.lit(target) - F.col("_rank")) / F.col("_size")).cast("int")
    return placed.filter(F.col("_rank") <= target).withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("_rank", "_size")


def capped_floor(counts: dict[str, int], total: int, floor: float = 0.10, ceiling: float = 0.30) -> dict[str, int]:
    """Share total among the names that have rows: at least floor and at most ceiling of it each, the rest in proportion.

    If the floors alone exceed total it is dealt evenly, the first names taking one more. What the floors leave goes out
    by largest remainders (ties: larger count, then later name) among names below the ceiling, round by round; what
    ceilings then leave goes one by one, from the largest count on. The ceiling is never below the floor. Counts are a few
    dozen numbers; no name with rows is an error.
    """
    names = sorted(n for n, rows in counts.items() if rows)
    if not names:
        raise ValueError("there are no rows to share the total among")
    low = min(round(total * floor), total)
    high = max(round(total * ceiling), round(total * floor))
    if low * len(names) > total:
        each, over = divmod(total, len(names))
        return {n: each + (k < over) for k, n in enumerate(names)}
    given = dict.fromkeys(names, low)
    by_size = sorted(names, key=lambda n: (counts[n], n), reverse=True)
    while (left := total - sum(given.values())) > 0:
        able = [n for n in by_size if given[n] < high]
        weight = sum(counts[n] for n in able)
        share = {n: left * (counts[n] / weight) for n in able}
        add = {n: min(int(share[n]), high - given[n]) for n in able}
        for n in sorted(able, key=lambda n: share[n] - int(share[n]), reverse=True):  # stable: ties as in by_size
            if sum(add.values()) < left and given[n] + add[n] < high:
                add[n] += 1
        if not any(add.values()):
            for k in range(left):
                given[by_size[k % len(names)]] += 1
        for n, more in add.items():
            given[n] += more
    return given


def permuted_labels(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """df with shuffled_label: the label of the row that has the same place in another hash order; so all counts stay.

    Both orders are of the whole table. Ids must be unique; rows that share one are taken in any order.
    """
    scored = df.withColumns({"_to": score(seed, "permute", id_col), "_from": score(seed, "permute labels", id_col)})
    labels = ranked(scored.select("_from", id_col, F.col(label).alias("shuffled_label")), [], ["_from", id_col], "_rank").select("_rank", "shuffled_label")
    return ranked(scored.drop("_from"), [], ["_to", id_col], "_rank").join(labels, "_rank").drop("_rank", "_to")


def split_overlap(df: DataFrame, split: str, key: str) -> DataFrame:
    """(a, b, shared): distinct keys that two splits share; keys are aggregated once, pairs of a key are few."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "a"))
    return left.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
