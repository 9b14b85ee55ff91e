"""N-gram Jaccard join: exact links between documents by prefix trees of globally ordered n-gram sets.

1. Rows are numbered and written with their texts; each text gives the set of hashes of its word n-grams. Rows with equal
   sets form a class, and one row of it goes on.
2. Candidates, without loss: two linked sets of a and b elements differ in at most (a + b) * (100 - p) / (100 + p) of them.
   Sets are cut into so many parts more than that by the hash of their elements, so that linked sets have several whole
   parts in common, one of them not empty; the hash of a part's content is a bucket key. How many parts depends on the
   size: sizes fall into ranges, and a set near the end of its range is cut as the next range is, too. (A set of which more
   parts than are spare are empty gives keys for its empty parts as well.)
3. In each bucket every member is compared with the bucket's centre, the member that shares the most buckets with others,
   in groups of one centre and a bounded number of members: their texts are read, and the difference to the centre's set is
   kept, as a set of hashes. That tells whether the two are linked.
4. Members of one centre that are then still in different components are joined by prefix trees of those differences:
   the symmetric difference of two sets is that of their differences to any third one, so nothing else is needed. Elements
   are ordered from rare to frequent, the same way for all sets of a tree; sets with a common beginning share a path. A
   probing set goes down the tree level by level with the overlap so far at each node, and a subtree is left as soon as
   what remains of its sets or of the probing one is too short to reach the limit, or all its sets are in the probing set's
   component. What is found at the end of a set is its exact overlap.

Groups are dealt to blocks, of trees and of probing sets, so no task holds more than a block of one group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, cut_with, named, need, salted_join, ship, small_side
from flowlens.llm.components import components, contracted
from flowlens.llm.neardup import buckets, meetings, parts
from flowlens.llm.shingles import mix, overlap, shingle_set

_U = np.uint64
_SIGNED = "node bigint, id bigint, n_shingles bigint, s1 bigint, s2 bigint, keys array<bigint>"
_DIFFERS = "head bigint, rep bigint, n bigint, linked boolean, differs array<bigint>"
_LINKS = "a bigint, b bigint"
#: Members of one centre in a group, sets of a tree, and elements that either may hold in about.
_GROUP, _BLOCK, _ELEMENTS = 64, 1024, 1 << 20


# --- candidates ---------------------------------------------------------------------------------------------------


@cache
def ranges(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(first size, last size, parts) of the ranges of sizes up to one that holds ``most``.

    A range ends at 4/3 of its first size, and at the largest size that its first may be linked with at least; so linked
    sets are in one range or in neighbouring ones. Parts are those that linked sets of the range may differ in, one more
    that is equal then, and a few spare ones for empty parts.
    """
    found, low = [], 1
    while not found or found[-1][1] < most:
        high = max(low * 4 // 3, low * 100 // percent)
        differ = 2 * high * (100 - percent) // (100 + percent)
        found.append((low, high, differ + 1 + (spare_parts(differ) if differ else 0)))
        low = high + 1
    return found


def spare_parts(differ: int) -> int:
    return 1 + differ // 50


def part_keys(got: np.ndarray, percent: int) -> np.ndarray:
    """Bucket keys of a non-empty set: one for each part of it that is not empty, in the one or two ways its size asks for."""
    n, keys = len(got), []
    scales = ranges(percent)
    at = bisect_right(scales, n, key=lambda r: r[0]) - 1
    for k in (at, at + 1):
        if k > at and n * 100 // percent < scales[k][0]:
            break  # no set of the next range is close enough
        count = scales[k][2]
        if count == 1:
            continue  # sets of these sizes are linked only if they are equal
        salt = mix(np.array([k + 1], dtype=_U))[0]
        placed = mix(got ^ salt)
        part = (placed % _U(count)).astype(np.int64)
        content = np.zeros(count, dtype=_U)
        np.add.at(content, part, mix(placed + salt))
        filled = np.bincount(part, minlength=count) > 0
        spare = spare_parts(2 * scales[k][1] * (100 - percent) // (100 + percent))
        wanted = np.flatnonzero(filled) if count - filled.sum() <= spare else np.arange(count)
        keys.append(mix(content[wanted] + mix(wanted.astype(_U) + salt)))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, dtype=np.int64)


def _signatures(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, s1, s2, keys = [], [], [], []
                for text in part.column(2).to_pylist():
                    got = shingle_set(text, k)
                    n.append(len(got))
                    two = np.array([got.sum(dtype=_U), mix(got).sum(dtype=_U)], dtype=_U).view(np.int64)
                    s1.append(int(two[0])), s2.append(int(two[1]))
                    keys.append(part_keys(got, percent) if len(got) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["node", "id", "n_shingles", "s1", "s2", "keys"],
                )

    return run


# --- centres and their members ------------------------------------------------------------------------------------


def _compared(k: int, percent: int):
    """Rows (head, salt, rep, text) come in that order: first the centre's own text (rep is null), then its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, one = None, np.empty(0, dtype=_U)
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
                out.append((head, rep, len(got), linked, np.setxor1d(got, one, assume_unique=True).view(np.int64)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _DIFFERS.split(", ")])

    return run


def _differences(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Each pair (head, rep, size) with the difference of both sets; size says how many partners head may have."""
    dealt = cut(pairs.select("head", F.pmod(F.xxhash64("rep"), parts("size", _GROUP)).cast("int").alias("salt"), "rep"), "pairs")
    members = dealt.join(texts.withColumnRenamed("node", "rep").hint("merge"), "rep").select("head", "salt", "rep", "text")
    centres = dealt.select("head", "salt").distinct().join(texts.withColumnRenamed("node", "head").hint("merge"), "head")
    rows = members.union(centres.select("head", "salt", F.lit(None).cast("bigint"), "text"))
    rows = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("rep").asc_nulls_first())
    return cut(rows.mapInArrow(_compared(k, percent), _DIFFERS), "differences")


# --- prefix trees -------------------------------------------------------------------------------------------------


class PrefixTree:
    """Sets as paths from rare to frequent elements, level by level in arrays.

    Two sets x and y of sizes nx and ny, given by their differences dx and dy to one other set, are linked if
    slack(x) + slack(y) <= 2 * (100 + p) * |dx and dy|, where slack = (100 + p) * |d| - (100 - p) * n: that is p percent
    of Jaccard similarity, in integers.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, percent: int) -> None:
        self.percent, self.weight = percent, 2 * (100 + percent)
        self.values, counts = np.unique(np.concatenate(sets), return_counts=True)
        self.rank = np.empty(len(self.values), dtype=np.int64)
        self.rank[np.lexsort((self.values, counts))] = np.arange(len(self.values))
        paths = [np.sort(self.rank[np.searchsorted(self.values, s)]) for s in sets]
        written = [p.astype(">u4").tobytes() for p in paths]
        self.order = np.array(sorted(range(len(sets)), key=written.__getitem__), dtype=np.int64)
        paths = [paths[i] for i in self.order]
        self.length = np.array([len(p) for p in paths], dtype=np.int64)
        self.slack = self.slacks(self.length, sizes[self.order])
        self.group = groups[self.order]
        reach = self.weight * self.length - self.slack
        common = np.zeros(len(paths), dtype=np.int64)  # elements shared with the path before
        for i in range(1, len(paths)):
            m = min(len(paths[i - 1]), len(paths[i]))
            unlike = np.flatnonzero(paths[i - 1][:m] != paths[i][:m])
            common[i] = unlike[0] if len(unlike) else m
        flat, start = np.concatenate(paths), np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.levels = []
        for level in range(int(self.length.max(initial=0))):
            bounds = np.flatnonzero(common <= level)
            node = self.length[bounds] > level
            first, ends = bounds[node], np.append(bounds[1:], len(paths))[node]
            low, high = np.minimum.reduceat(self.group, bounds)[node], np.maximum.reduceat(self.group, bounds)[node]
            self.levels.append((
                first, ends, flat[start[first] + level], np.minimum.reduceat(self.slack, bounds)[node], np.maximum.reduceat(reach, bounds)[node],
                np.where(low == high, low, -1),
            ))

    def slacks(self, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * lengths - (100 - self.percent) * sizes

    def linked(self, probe: np.ndarray, size: int, group: int) -> np.ndarray:
        """Places (in the list given) of the sets of other groups that are linked with the probing set."""
        slack = int(self.slacks(np.int64(len(probe)), np.int64(size)))
        at = np.minimum(np.searchsorted(self.values, probe), len(self.values) - 1)
        known = np.sort(self.rank[at[self.values[at] == probe]])
        found = [np.flatnonzero((self.length == 0) & (self.group != group) & (slack + self.slack <= 0))]
        if not len(known):
            found = [np.flatnonzero((self.group != group) & (slack + self.slack <= 0))]
        elif self.levels:
            front, shared = np.arange(len(self.levels[0][0])), np.zeros(len(self.levels[0][0]), dtype=np.int64)
            for level, (first, ends, element, least_slack, reach, one_group) in enumerate(self.levels):
                passed = np.searchsorted(known, element[front], "right")
                shared = shared + ((passed > 0) & (known[passed - 1] == element[front]))
                begin = first[front]
                done = (self.length[begin] == level + 1) & (self.group[begin] != group) & (slack + self.slack[begin] <= self.weight * shared)
                found.append(begin[done])
                open_ = (
                    (slack <= self.weight * (shared - level - 1) + reach[front])
                    & (slack + least_slack[front] <= self.weight * (shared + len(known) - passed))
                    & (one_group[front] != group)
                )
                front, shared = front[open_], shared[open_]
                if not len(front) or level + 1 == len(self.levels):
                    break
                below = self.levels[level + 1][0]
                begin, end = np.searchsorted(below, first[front]), np.searchsorted(below, ends[front])
                many = end - begin
                shared = np.repeat(shared, many)
                front = np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
                if not len(front):
                    break
        return self.order[np.concatenate(found)]


def _joined(percent: int):
    """Rows (kind, grp, x, y, probe, rep, comp, n, differs) come in that order; links that join no new components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, tree, parent, names = None, [], None, {}, {}

        def top(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        for batch in batches:
            out = []
            at = zip(*(batch.column(c).to_pylist() for c in ("kind", "grp", "x", "y")), strict=True)
            rest = (batch.column(c).to_pylist() for c in ("probe", "rep", "comp", "n"))
            for here, probe, rep, comp, n, differs in zip(at, *rest, batch.column("differs"), strict=True):
                if here != key:
                    key, members, tree, parent, names = here, [], None, {}, {}
                one = differs.values.to_numpy(zero_copy_only=False).view(_U)
                group = names.setdefault(comp, len(names))
                if not probe:
                    members.append((rep, group, n, one))
                    continue
                if tree is None:
                    tree = PrefixTree([m[3] for m in members], np.array([m[2] for m in members], dtype=np.int64), np.array([m[1] for m in members], dtype=np.int64), percent)
                for k in tree.linked(one, n, group):
                    a, b = top(group), top(members[k][1])
                    if a != b:
                        parent[a] = b
                        out.append((rep, members[k][0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _crossing(members: DataFrame, differences: DataFrame, roots: DataFrame, sizes: DataFrame, n_classes: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket in different components."""
    labelled = members.filter("rep <> head").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    grouped, seen = cut_with(meetings(labelled.select("key", "size", "rep", "head", F.coalesce("root", "rep").alias("comp")), n_classes), "groups", n=F.count(F.lit(1)))
    counts = grouped.groupBy("kind", "grp", "comp").agg(F.count(F.lit(1)).alias("rows"))
    mains = counts.groupBy("kind", "grp").agg(F.max(F.struct("rows", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    spokes = salted_join(grouped, mains.select("kind", "grp", "main"), ["kind", "grp"], ["rep"], seen["n"])
    spokes = spokes.join(differences.drop("linked"), ["head", "rep"])
    head_sizes = sizes.withColumnRenamed("rep", "head").withColumnRenamed("n", "head_n").join(grouped.select("head").distinct(), "head", "left_semi")
    spokes = salted_join(spokes, head_sizes, ["head"], ["rep"], seen["n"])
    blocks = F.ceil(F.col("size") * F.greatest(F.lit(1.0), F.col("head_n") * _BLOCK / _ELEMENTS) / _BLOCK).cast("int")
    rest = cut(spokes.select("kind", "grp", blocks.alias("blocks"), "rep", "comp", "n", "differs", (F.col("comp") != F.col("main")).alias("outside")), "open")
    block_of, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = ("rep", "comp", "n", "differs")
    trees = rest.select("kind", "grp", block_of.alias("x"), every.alias("y"), F.lit(False).alias("probe"), *own)
    probes = rest.filter("outside").select("kind", "grp", every.alias("x"), block_of.alias("y"), F.lit(True).alias("probe"), *own)
    rows = trees.union(probes).repartition("kind", "grp", "x", "y").sortWithinPartitions("kind", "grp", "x", "y", "probe")
    return rows.mapInArrow(_joined(percent), _LINKS)


# --- the whole ----------------------------------------------------------------------------------------------------


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of k-word shingles; a text of fewer
    words is one shingle. component_id is the smallest id that links reach, the document's own included. No link between
    different sets is lost: candidates come from an exact bound, and sets are compared whole.

    Null text counts as empty; documents without words are linked with nothing. Each row goes by its own text, whatever ids
    it shares with others; a null id is larger than all others, so a component has a null id only if all of its rows do.
    Empty tables give no rows. Columns besides the two named are ignored, whatever their names. percent is 50 to 99.
    """
    need(docs, [id_col, text_col])
    if not 50 <= percent <= 99:
        raise ValueError("percent must be 50 to 99")
    ship(docs.sparkSession)
    rows = cut(docs.select(F.monotonically_increasing_id().alias("node"), named(id_col).cast("bigint").alias("id"), named(text_col).alias("text")), "rows")
    signed = cut(rows.mapInArrow(_signatures(k, percent), _SIGNED), "signatures")
    real = signed.filter("n_shingles > 0")
    classes, seen = cut_with(
        real.groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.min("id").alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("bands")),
        "classes", n=F.count(F.lit(1)),
    )
    members = buckets(classes)
    ids = members.select(F.col("rep").alias("node")).distinct()
    texts = rows.select("node", "text").join(small_side(ids, seen["n"], 1_000_000), "node", "left_semi")
    stars = members.filter("rep <> head").groupBy("head", "rep").agg(F.max("size").alias("size"))
    differences = _differences(stars, texts, k, percent)
    roots = components(differences.filter("linked").select(F.col("head").alias("a"), F.col("rep").alias("b")))
    more = _crossing(members, differences, roots, classes.select("rep", "n"), seen["n"], percent)
    roots = contracted(roots, more)

    linked = roots.withColumnRenamed("id", "rep").join(classes.select("rep", "first"), "rep")
    firsts = linked.groupBy("root").agg(F.min("first").alias("group_first"))
    groups = linked.select("rep", "root").join(firsts, "root").select("rep", "group_first")
    heads = classes.join(groups, "rep", "left").select("s1", "s2", F.coalesce("group_first", "first").alias("component_id"))
    found = real.select("id", "n_shingles", "s1", "s2").join(heads, ["s1", "s2"]).select("id", "n_shingles", "component_id")
    none = signed.filter("n_shingles = 0").select("id", "n_shingles", F.col("id"))
    return found.union(none).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
