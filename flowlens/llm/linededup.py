"""Cross-site boilerplate lines by distinct-site spread, with DataFrame functions only.

Each line's hash gathers a HyperLogLog sketch of the sites it is found on; sketches merge by aggregation, so a line on
a third of all rows is combined on the map side. Lines whose estimate is clearly above the threshold are boilerplate,
lines near it get an exact count of distinct sites, the rest stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, let, named, need, salted_join, spare

MIN_SITES, LG_K, MARGIN = 8, 10, 0.25
_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, th, site, pos, h1, h2) of each line with a word; th tells apart the texts of one id."""
    line = F.trim("line")
    return (
        docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("th"), named(site_col).alias("site"), F.posexplode(F.split(named(text_col), "\n")).alias("pos", "line"))
        .filter(F.regexp_like("line", F.lit(_WORD)))
        .select("id", "th", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h1, h2) of lines(h1, h2, site) that are found on min_sites distinct sites or more; null sites do not count.

    Both aggregations are combined before their shuffle: of a line that stands everywhere, a task sends one sketch, or
    one row a site.
    """
    known = lines.filter("site is not null").select("h1", "h2", F.xxhash64("site").alias("site"))
    # Lines that are found on one site only, nearly all, are told by least and largest site hash; their sketches stay behind.
    spread = known.groupBy("h1", "h2").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    several = spread.filter("lo <> hi") if min_sites > 1 else spread
    judged = cut(several.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "sites")
    clear = judged.filter(F.col("sites") > min_sites * (1 + margin)).select("h1", "h2")
    near = judged.filter(F.col("sites").between(min_sites * (1 - margin), min_sites * (1 + margin))).select("h1", "h2")
    # Distinct before the join where that is a shuffle, so that no frequent line is.
    rows = near.count()
    once = known if rows <= 100_000 else known.distinct()
    exact = (
        salted_join(once, near, ["h1", "h2"], ["site"], rows, "left_semi").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
        .filter(F.col("sites") >= min_sites).select("h1", "h2")
    )
    return clear.union(exact)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(id, th, positions): which lines of each text go, th being its xxhash64; texts that keep all their lines have no row.

    A boilerplate line stays where it comes first (smallest id, null before all, then position) and goes everywhere else.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    found = cut(boilerplate(lines, min_sites), "boilerplate")
    rows = found.count()
    hits = cut(salted_join(lines, found, ["h1", "h2"], ["id", "th", "pos"], rows).select("h1", "h2", "id", "th", "pos"), "hits")
    first = hits.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos", "th")).alias("first"))
    gone = salted_join(hits, first, ["h1", "h2"], ["id", "th", "pos"], rows).filter(~F.struct("id", "pos", "th").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "th").agg(F.collect_set("pos").alias("positions"))


def _kept(text: Column, gone: Column) -> Column:
    """text without the lines at the places gone."""

    def body(lines):
        # array_except looks places up in a hash set, so that texts of very many lines take linear time.
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: lines[i]), "\n")

    return let(F.split(text, "\n"), body)


def without_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES,
    lines_as: str = "n_lines", removed_as: str = "n_removed",
) -> DataFrame:
    """docs with cross-site boilerplate lines taken out of text_col, plus n_lines and n_removed (lines with a word only).

    Lines are compared after trimming spaces and count once per distinct site; lines without a word always stay, and so
    does the first copy (smallest id, then position) of each boilerplate line. Null text stays null with 0 lines. Removal
    goes by id and text: rows that repeat both count as one document and lose the same lines, other texts under the same
    id are documents of their own. A null id is an id before all others; null sites are not counted, and neither is a
    reason to drop anything. Empty tables give none. Texts are taken whole at any length. Other columns stay as they are,
    whatever their names; only columns called lines_as and removed_as would be replaced.
    """
    need(docs, [id_col, text_col, site_col])
    gone = removed_lines(docs, id_col, text_col, site_col, min_sites)
    own_hash, gone_id, gone_hash, positions = spare(docs, "th", "gone_id", "gone_th", "positions")
    gone = gone.toDF(gone_id, gone_hash, positions)
    hashed = docs.withColumn(own_hash, F.xxhash64(named(text_col)))
    same = named(id_col).eqNullSafe(named(gone_id)) & (named(own_hash) == named(gone_hash))
    # One kind of join at every size: how many documents lose lines grows with docs, so their positions are no side to broadcast.
    both = hashed.join(gone.hint("merge"), same, "left")
    text, removed = named(text_col), named(positions)
    words = F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(_WORD))))
    facts = {
        lines_as: F.when(text.isNull(), 0).otherwise(words).cast("bigint"),
        removed_as: F.coalesce(F.size(removed), F.lit(0)).cast("bigint"),
        text_col: F.when(removed.isNull(), text).otherwise(_kept(text, removed)),
    }
    return both.withColumns(facts).drop(own_hash, gone_id, gone_hash, positions)
