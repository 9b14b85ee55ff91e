"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. Rows are numbered and written out with their texts. Each document's set of 5-word shingles gives 128 minima. Bands of
   four minima make 32 bucket keys; two mixed bits of all minima are packed into 256 bits.
2. Documents with equal sets form a class; only one row of it goes on, so exact copies never meet in pairs.
3. In each bucket every member is paired with the bucket's centre only: the member that shares the most buckets with
   others, as the original of many copies does. Pairs whose estimate from the packed bits (corrected for chance
   agreement of two-bit values) is far below the limit go; the rest are confirmed on full sets, in groups of one centre
   and a bounded number of members.
4. Buckets whose members are then still in several components get a second pass over the pairs that cross components,
   less those that an exact bound rules out. Each tested pair left 1024-bit maps of what the member has besides the
   centre's set and of what it lacks of it. x and y share at most the centre's set less the bits set in either map of
   what lacks, plus what x has besides less the bits that only its map has (or the same for y, if that is less). Members
   meet in groups, the buckets of one centre taken together where that makes fewer comparisons. They are dealt to blocks
   of bounded size; those outside the group's largest component go to every block, where they meet members of about their
   own number of shingles. Every pair of a bucket is thereby tested, ruled out or known to be connected.

A true link of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6; the estimate drops it with
probability 3e-6 (4.5 standard deviations) if places are independent. In 20,000 simulated pairs each at that limit it
dropped none of 4 and 3 shingles, one of 7 and 7, 8 and 6, and 12 and 9, and none of 20 and 15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, cut_with, named, need, salted_join, ship, small_side
from flowlens.llm.components import components, contracted
from flowlens.llm.shingles import mix, overlap, shingle_set

BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
_LONGS = HASHES * BITS // 64
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """128 minima of a non-empty set of 64-bit hashes."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        block = short[None, at : at + 2048] * _MUL[:, None] + _ADD[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    mixed = mix(low.astype(np.uint64).reshape(BANDS, ROWS) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    return mix((mixed * _FOLD).sum(axis=1, dtype=np.uint64)).view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 minima to a 64-bit integer.

    Minima are mixed first: the low bits of x * odd + c depend on those of x only, so that two shingles would agree by
    chance in all places or in none.
    """
    two = (mix(low.astype(np.uint64)) & np.uint64(3)).reshape(_LONGS, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return (two << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def bit_map(values: np.ndarray) -> np.ndarray:
    """1024 bits with one set for each value: disjoint maps mean disjoint sets."""
    bits = np.zeros(1024, dtype=np.uint8)
    bits[(values & np.uint64(1023)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _bits_set(words: list[Column]) -> Column:
    count = F.bit_count(words[0])
    for w in words[1:]:
        count = count + F.bit_count(w)
    return count


def most_shared(a: dict[str, Column], b: dict[str, Column], centre_size: Column) -> Column:
    """The most that two sets can have in common, from their maps against one centre.

    Each side gives besides (how many of its elements the centre lacks), more (their map) and less (the map of the
    centre's elements that it lacks). A bit that is set stands for one element at least, so bits count from below what
    is missing or what one side has alone.
    """
    every = range(1024 // 64)
    lacking = _bits_set([a["less"][k].bitwiseOR(b["less"][k]) for k in every])
    alone = [
        x["besides"] - _bits_set([x["more"][k].bitwiseAND(F.bitwise_not(y["more"][k])) for k in every])
        for x, y in ((a, b), (b, a))
    ]
    return centre_size - lacking + F.least(*alone)


def agreeing(a: Column, b: Column) -> Column:
    """In how many of the 128 places two packed signatures agree, by bit counts."""
    odd = F.lit(0x5555555555555555).cast("bigint")
    differ = F.lit(0)
    for k in range(_LONGS):
        x = a[k].bitwiseXOR(b[k])
        differ = differ + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd))
    return F.lit(HASHES) - differ


def estimated(matches: Column) -> Column:
    """Similarity from agreeing places; two unequal minima agree in two bits by chance in a quarter of cases."""
    chance = 1.0 / (1 << BITS)
    return (matches / HASHES - chance) / (1 - chance)


def least_matches(percent: int) -> int:
    """4.5 standard deviations below what a pair at the limit has on average."""
    p = percent / 100
    p += (1 - p) / (1 << BITS)
    return int(HASHES * p - 4.5 * (HASHES * p * (1 - p)) ** 0.5)


_SIGNED = "node bigint, id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, bits array<bigint>"
_TESTED = "head bigint, rep bigint, both bigint, linked boolean, more array<bigint>, less array<bigint>"
#: Members of one centre that are confirmed in one group, and members of a second-pass block.
_GROUP, _BLOCK = 64, 1024


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, s1, s2, bands, bits = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    got = shingle_set(text, k)
                    n.append(len(got))
                    if len(got):
                        two = np.array([got.sum(dtype=np.uint64), mix(got).sum(dtype=np.uint64)]).view(np.int64)
                        low = minima(got)
                        s1.append(int(two[0])), s2.append(int(two[1]))
                        bands.append(band_keys(low)), bits.append(packed_bits(low))
                    else:
                        s1.append(None), s2.append(None), bands.append(None), bits.append(None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, longs), pa.array(bits, longs)],
                    ["node", "id", "n_shingles", "s1", "s2", "bands", "bits"],
                )

    return run


def _confirm(k: int, percent: int, maps: bool):
    """Rows (head, salt, rep, text) come in that order: first the centre's own text (rep is null), then its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, one = None, np.empty(0, dtype=np.uint64)
        longs = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for head, rep, text in zip(batch.column("head").to_pylist(), batch.column("rep").to_pylist(), batch.column("text"), strict=True):
                got = shingle_set(text.as_py(), k)
                if rep is None:
                    centre, one = head, got
                    continue
                if centre != head:
                    raise ValueError(f"the text of row {head} is missing")
                both = overlap(one, got)
                linked = 100 * both >= percent * (len(one) + len(got) - both)
                more = bit_map(np.setdiff1d(got, one, assume_unique=True)) if maps else None
                less = bit_map(np.setdiff1d(one, got, assume_unique=True)) if maps else None
                out.append((head, rep, both, linked, more, less))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), longs, longs]
                names = [c.split()[0] for c in _TESTED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def buckets(classes: DataFrame) -> DataFrame:
    """(key, size, rep, head) of every bucket with several members; head is its centre."""
    placed = classes.select("rep", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    inside = cut(placed.join(shared.hint("merge"), "key"), "buckets")
    weights = inside.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = inside.join(weights.hint("merge"), "rep")
    centres = weighed.groupBy("key").agg((-F.max(F.struct("weight", -F.col("rep")))["col2"]).alias("head"))
    return cut(inside.select("key", "size", "rep").join(centres.hint("merge"), "key"), "members")


def parts(size: str, rows: int) -> Column:
    """Into how many parts of about that many rows a group of so many is dealt."""
    return F.ceil(F.col(size) / rows).cast("int")


def _worth_testing(pairs: DataFrame, bits: DataFrame, n_classes: int, percent: int, least: int) -> DataFrame:
    """The rows of pairs (head, rep, ...) whose sizes and packed bits do not rule out that both are alike; a head may be in very many."""
    x, y = (bits.select(F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in ("head", "rep"))
    heads = x.join(pairs.select("head").distinct().hint("merge"), "head", "left_semi")
    both = salted_join(pairs.join(y.hint("merge"), "rep"), heads, ["head"], ["rep"], n_classes)
    return both.filter(F.least("head_n", "rep_n") * 100 >= F.greatest("head_n", "rep_n") * percent).filter(
        agreeing(F.col("head_bits"), F.col("rep_bits")) >= least
    ).select(*pairs.columns)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, maps: bool) -> DataFrame:
    """Each pair (head, rep, size) with the size of what both sets hold, whether they are linked, and maps of how they differ.

    size says how many partners head may have: they are dealt to groups of about _GROUP, and the text of head is sent to
    each group once.
    """
    dealt = cut(pairs.select("head", F.pmod(F.xxhash64("rep"), parts("size", _GROUP)).cast("int").alias("salt"), "rep"), "pairs")
    members = dealt.join(texts.withColumnRenamed("node", "rep").hint("merge"), "rep").select("head", "salt", "rep", "text")
    centres = dealt.select("head", "salt").distinct().join(texts.withColumnRenamed("node", "head").hint("merge"), "head")
    rows = members.union(centres.select("head", "salt", F.lit(None).cast("bigint"), "text"))
    rows = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("rep").asc_nulls_first())
    return cut(rows.mapInArrow(_confirm(k, percent, maps), _TESTED), "confirmed")


def meetings(members: DataFrame, n_classes: int) -> DataFrame:
    """(kind, grp, size, head, rep, comp): the groups in which members other than their centre are to be compared with each other.

    Copies of one original share many buckets, all with the same centre. Where that makes fewer comparisons, the buckets
    of a centre are one group, in which each member stands once; else each bucket is a group.
    """
    apart = members.groupBy("head", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("head").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    once = members.groupBy("head", "rep").agg(F.first("comp").alias("comp"))
    choice = once.groupBy("head").agg(F.count(F.lit(1)).alias("m")).join(apart, "head")
    choice = choice.select("head", "m", (F.col("m") * F.col("m") <= F.col("apart")).alias("whole"))
    whole = salted_join(once, choice.filter("whole"), ["head"], ["rep"], n_classes)
    apiece = salted_join(members, choice.filter("not whole"), ["head"], ["rep"], n_classes)
    return whole.select(F.lit(0).alias("kind"), F.col("head").alias("grp"), F.col("m").alias("size"), "head", "rep", "comp").union(
        apiece.select(F.lit(1), "key", "size", "head", "rep", "comp")
    )


def _crossing(members: DataFrame, tested: DataFrame, roots: DataFrame, bits: DataFrame, n_classes: int, percent: int) -> DataFrame | None:
    """Pairs (head, rep, size) of members of one bucket in different components that no exact bound rules out; None if there are none.

    Pairs with the bucket's centre were tested before. Of any other pair across components one side at least is outside
    the group's largest component: all members are dealt to blocks, and those outsiders go to every block.
    """
    labelled = members.filter("rep <> head").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    met = meetings(labelled.select("key", "size", "rep", "head", F.coalesce("root", "rep").alias("comp")), n_classes)
    grouped, seen = cut_with(met, "groups", n=F.count(F.lit(1)))
    counts = grouped.groupBy("kind", "grp", "comp").agg(F.count(F.lit(1)).alias("rows"))
    mains = counts.groupBy("kind", "grp").agg(F.max(F.struct("rows", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    # Of groups and of heads there are no more than rows; one of them may hold a third of those.
    spokes = salted_join(grouped, mains.select("kind", "grp", "main"), ["kind", "grp"], ["rep"], seen["n"])
    spokes = spokes.join(bits, "rep").join(tested.drop("linked"), ["head", "rep"], "left")
    head_sizes = bits.select(F.col("rep").alias("head"), F.col("n").alias("head_n")).join(grouped.select("head").distinct(), "head", "left_semi")
    # Sizes on a scale whose step is the limit: of two sets that are alike, the larger one is on the same step or the next.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    spokes = salted_join(spokes, head_sizes, ["head"], ["rep"], seen["n"]).withColumns({"step": step, "outside": F.col("comp") != F.col("main")})
    rest, seen = cut_with(spokes.select("kind", "grp", "size", "step", "outside", "rep", "comp", "n", "bits", "both", "more", "less", "head_n"), "open", n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    carried = ("outside", "rep", "comp", "n", "bits", "both", "more", "less")
    blocks = parts("size", _BLOCK)
    x = rest.withColumns({"x_kind": F.col("kind"), "x_grp": F.col("grp"), "x_step": F.col("step"), "x_block": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    x = x.select("x_kind", "x_grp", "x_step", "x_block", "size", "head_n", *[F.col(c).alias(f"a_{c}") for c in carried])
    y = rest.filter("outside").withColumn("step", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)))
    y = y.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("kind", "grp", "step", "block", *[F.col(c).alias(f"b_{c}") for c in carried])
    side = [{"besides": F.col(f"{c}_n") - F.col(f"{c}_both"), "more": F.col(f"{c}_more"), "less": F.col(f"{c}_less")} for c in "ab"]
    most = F.least(most_shared(*side, F.col("head_n")), "a_n", "b_n")
    alike = (
        (F.col("x_kind") == F.col("kind")) & (F.col("x_grp") == F.col("grp")) & (F.col("x_step") == F.col("step")) & (F.col("x_block") == F.col("block"))
        & (F.col("a_comp") != F.col("b_comp"))
        & (~F.col("a_outside") | (F.col("a_rep") < F.col("b_rep")))  # two outsiders meet twice
        & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
        & (agreeing(F.col("a_bits"), F.col("b_bits")) >= least_matches(percent))
        & F.coalesce(100 * most >= percent * (F.col("a_n") + F.col("b_n") - most), F.lit(True))
    )
    pairs = x.join(y.hint("merge"), alike).groupBy(F.col("a_rep").alias("head"), F.col("b_rep").alias("rep")).agg(F.max("size").alias("size"))
    found, seen = cut_with(pairs, "crossing", n=F.count(F.lit(1)))
    return found if seen["n"] else None


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, row_col: str | None = None
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept, stays) per row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the
    smallest id that links reach, kept says whether the document has that id. stays is true for exactly one row of each
    group: that with the smallest id, null ids last; of rows that repeat it, any one.

    Null text counts as empty; documents without words are linked with nothing, are their own component, are kept and
    stay. Texts are read whole, at any length. Each row goes by its own text, whatever ids it shares with others; groups
    of which all ids are null have a null component_id, and kept is then stays. Empty tables give no rows. Columns besides
    the two named are ignored, whatever their names. row_col names a column of unique numbers of a written table; it is
    then returned too, as row, and rows are not numbered and written again.
    """
    need(docs, [id_col, text_col, *([row_col] if row_col else [])])
    ship(docs.sparkSession)
    columns = [named(id_col).cast("bigint").alias("id"), named(text_col).alias("text")]
    if row_col:
        rows = docs.select(named(row_col).cast("bigint").alias("node"), *columns)
    else:
        rows = cut(docs.select(F.monotonically_increasing_id().alias("node"), *columns), "rows")
    texts = rows.select("node", "text")
    signed = cut(rows.mapInArrow(_signatures(k), _SIGNED), "signatures")
    real = signed.filter("n_shingles > 0")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")  # the least one stands for its group
    classes, seen = cut_with(
        real.groupBy("s1", "s2").agg(
            F.min("node").alias("rep"), F.min(place).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
        ),
        "classes", n=F.count(F.lit(1)),
    )
    members = buckets(classes)
    ids = members.select(F.col("rep").alias("node")).distinct()
    wanted = texts.join(small_side(ids, seen["n"], 1_000_000), "node", "left_semi")
    bits = classes.select("rep", "n", "bits")
    # The centres are tested more widely than links need: their overlaps rule out pairs of others below.
    stars = members.filter("rep <> head").groupBy("head", "rep").agg(F.max("size").alias("size"))
    tested = _confirmed(_worth_testing(stars, bits, seen["n"], percent, least_matches(percent * 2 // 5)), wanted, k, percent, True)
    roots = components(tested.filter("linked").select(F.col("head").alias("a"), F.col("rep").alias("b")))
    crossing = _crossing(members, tested, roots, bits, seen["n"], percent)
    if crossing is not None:
        more = _confirmed(crossing, wanted, k, percent, False).filter("linked").select("head", "rep")
        roots = contracted(roots, more.toDF("a", "b"))

    linked = roots.withColumnRenamed("id", "rep").join(classes.select("rep", "first"), "rep")
    firsts = linked.groupBy("root").agg(F.min("first").alias("group_first"))
    groups = linked.select("rep", "root").join(firsts, "root").select("rep", "group_first")
    heads = classes.join(groups, "rep", "left").select("s1", "s2", F.coalesce("group_first", "first").alias("first"))
    found = real.select("node", "id", "n_shingles", "s1", "s2").join(heads, ["s1", "s2"]).select(
        "node", "id", "n_shingles", F.col("first.id").alias("comp"), (F.col("node") == F.col("first.node")).alias("stays")
    )
    none = signed.filter("n_shingles = 0").select("node", "id", "n_shingles", F.col("id").alias("comp"), F.lit(True).alias("stays"))
    return found.union(none).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("comp").alias("component_id"),
        F.when(F.col("comp").isNull(), F.col("stays")).otherwise(F.col("id").eqNullSafe(F.col("comp"))).alias("kept"),
        "stays",
        *([F.col("node").alias("row")] if row_col else []),
    )
