"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut_with

#: A node with more neighbours than this, and than a ten-thousandth of all links, is a hub.
_HUB = 100_000


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links(a, b); root is the smallest id that can be reached.

    Alternating large-star and small-star rounds: each node points itself and its neighbours at the smallest of them,
    until nothing changes. A round is two aggregations (combined before the shuffle) and two equi-joins, so a node
    with very many neighbours is never gathered in one row; the table is written out after each round. Hubs, of which
    there can be no more than 20,000, are joined by broadcast, so that the links of one are not one task either.
    Loops and null ids are ignored; no links give an empty result.
    """
    now, mark = _written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while mark[0] and mark != seen:
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links")).withColumn("m", F.least("u", "m"))
        large = _looked_up(both.filter("v > u"), least, mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
        small = _looked_up(large, low, mark[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, mark = _written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )


def _looked_up(links: DataFrame, per_node: DataFrame, n: int) -> DataFrame:
    """links(u, v) with m of per_node(u, m, links); n is the number of all links, each of which has two ends."""
    hub = max(_HUB, n // 10_000)
    nodes = per_node.select("u", "m")
    if 2 * n <= hub:
        return links.join(nodes, "u")
    hubs = F.broadcast(per_node.filter(F.col("links") > hub).select("u", "m"))  # 2 * n / hub rows at most
    return links.join(hubs, "u").unionByName(links.join(hubs, "u", "left_anti").join(nodes, "u"))


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of roots(id, root) after links(a, b) between ids have been added; ids without a root are their own."""
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("id").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    upper = components(links.select("a", "b")).toDF("root", "top")
    lower = roots.union(upper.select("root", "root")).distinct()
    return lower.join(upper, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table written out, with its row count and an order-free digest to see whether a round changed anything."""
    h = F.xxhash64("u", "v")
    out, seen = cut_with(edges, "links", n=F.count(F.lit(1)), total=F.sum(h.cast("decimal(38,0)")), mixed=F.bit_xor(h))
    return out, (seen["n"], seen["total"], seen["mixed"])
