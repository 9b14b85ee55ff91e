"""Spelling variants: words that one edit turns into each other, joined by an inverted index of positional q-grams.

1. A word with q - 1 marks before and after it has length + q - 1 grams of q characters. One inserted, deleted or replaced
   code point destroys at most q of them and moves the others by at most one place, so words that are one edit apart share
   at least (length of the longer one) - 1 grams, at places that differ by no more than their lengths do.
2. Of any q + 1 grams of a word one survives the edit. Each word is sent to the groups (gram, place, length) of its q + 1
   rarest grams only, and there it meets words of its own length and words longer by one. Rarity is counted over all words
   in 65,536 hashed cells, so what is sent to the tasks has a fixed size; the order is the same for all words, and the
   first surviving gram of both words is the same one.
3. A group holds an inverted index (gram, place) -> words of its own words. For each word that probes it, the posting lists
   of its grams at the places allowed are merged by a heap: those of its rarest grams in the group, one gram more than a near
   word may lack, as every near word is in one of them; the longer lists are looked up for what comes up. Words that are in
   enough lists (the count filter) are verified code point by code point. Large groups are dealt to blocks of index words
   and of probing words, so no task holds more than two blocks of one group.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, cut_with, named, need, ship

#: Runs of Latin letters; the range holds the multiplication and division signs too.
LETTERS = "[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Q = 3
_BEFORE, _AFTER = "\x02", "\x03"
_CELLS = 1 << 16
_BLOCK = 2048
_ROUTED = "size int, place int, gram string, own boolean, word string, n bigint"
_PAIRS = "a string, a_n bigint, b string, b_n bigint"


def word_runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, run) for every maximal run of letters of at least so many code points, A-Z lower-cased."""
    runs = F.regexp_extract_all(named(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select(named(id_col).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))


def with_slips(runs: DataFrame, every: int) -> Column:
    """The run, with one code point left out where the hash of id and run is divisible by ``every``; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    left_out = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return F.when(h % every == 0, left_out).otherwise(F.col("run"))


def counted(words: DataFrame, least_chars: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n) of the words of a column ``word`` that are long and frequent enough."""
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def grams(word: str) -> list[str]:
    padded = _BEFORE * (Q - 1) + word + _AFTER * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def one_edit(longer: str, other: str) -> bool:
    """Exactly one code point inserted, deleted or replaced; longer is not the shorter one of the two."""
    if longer == other or len(longer) - len(other) not in (0, 1):
        return False
    same = 0
    while same < len(other) and longer[same] == other[same]:
        same += 1
    return longer[same + 1 :] == other[same + (len(longer) == len(other)) :]


def _cell(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % _CELLS


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CELLS, dtype=np.int64)
    for batch in batches:
        for word in batch.column("word").to_pylist():
            for g in grams(word):
                total[_cell(g)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])


def _routed(common):
    """Each word in the groups of its rarest grams: as one of the group's own length, and as one that is longer by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        for batch in batches:
            size, place, gram, own, words, counts = [], [], [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                first = sorted((int(often[_cell(g)]), g, i) for i, g in enumerate(grams(word)))[: Q + 1]
                # Of a word longer by one, a gram stands at the same place or one further on.
                places = {(len(word), i, g, True) for _, g, i in first} | {(len(word) - 1, j, g, False) for _, g, i in first for j in (i - 1, i) if j >= 0}
                for a, b, c, d in places:
                    size.append(a), place.append(b), gram.append(c), own.append(d), words.append(word), counts.append(n)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((size, place, gram, own, words, counts), kinds, strict=True)], [c.split()[0] for c in _ROUTED.split(", ")])

    return run


class Postings:
    """Words of one length, by (gram, place)."""

    def __init__(self, size: int) -> None:
        self.size, self.words, self.lists, self.at = size, [], {}, {}

    def add(self, word: str, n: int) -> None:
        for at in enumerate(grams(word)):
            self.lists.setdefault(at, []).append(len(self.words))
        self.at[word] = len(self.words)
        self.words.append((word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words one edit away; of those of the same length only the smaller ones, as the larger find this one."""
        longer = len(word) - self.size
        found = [[got for j in range(i - longer, i + 1) if (got := self.lists.get((j, g)))] for i, g in enumerate(grams(word))]
        spare = len(found) - (len(word) + Q - 1 - Q)  # grams that a near word may lack
        found.sort(key=lambda lists: sum(map(len, lists)))
        short, rest, me = found[: spare + 1], found[spare + 1 :], self.at.get(word, -1)
        for k, times in groupby(heapq.merge(*[x for lists in short for x in lists])):
            other, n = self.words[k]
            if k == me or not longer and other > word:
                continue
            lacks = spare + 1 - sum(1 for _ in times)
            for lists in rest:
                if lacks > spare:
                    break
                lacks += not any((at := bisect_left(x, k)) < len(x) and x[at] == k for x in lists)
            if lacks <= spare and one_edit(word, other):
                yield other, n


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and block, the index words of each first."""
    key, index = None, None
    for batch in batches:
        out = []
        at = zip(*(batch.column(c).to_pylist() for c in ("size", "place", "gram", "x", "y")), strict=True)
        for here, probe, word, n in zip(at, *(batch.column(c).to_pylist() for c in ("probe", "word", "n")), strict=True):
            if here != key:
                key, index = here, Postings(here[0])
            if not probe:
                index.add(word, n)
            else:
                out += [(word, n, other, other_n) for other, other_n in index.near(word)]
        if out:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _PAIRS.split(", ")])


def near_pairs(words: DataFrame, block: int = _BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): every pair of different words of a table (word, n) that one edit turns into each other, once.

    Words must be distinct and have two code points at least: two words of one letter share no gram. Shorter and null
    words are near nothing. No words give no pairs.
    """
    spark = words.sparkSession
    ship(spark)
    words = words.filter(F.length("word") >= 2).select("word", F.col("n").cast("bigint").alias("n"))
    often = np.zeros(_CELLS, dtype=np.int64)
    for r in words.select("word").mapInArrow(_gram_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        often[r.cell] = r.n  # a row a cell, 65,536 at most
    group = ["size", "place", "gram"]
    routed = cut(words.mapInArrow(_routed(spark.sparkContext.broadcast(often)), _ROUTED), "routed")
    sizes = routed.groupBy(*group).agg(F.count_if("own").alias("index"), F.count(F.lit(1)).alias("all")).filter("index > 0 and all > 1")
    parts = lambda rows: F.ceil(F.col(rows) / block).cast("int")
    placed = routed.join(sizes.select(*group, parts("index").alias("xs"), parts("all").alias("ys")), group)
    block_of = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = placed.filter("own").select(*group, block_of("xs").alias("x"), every("ys").alias("y"), F.lit(False).alias("probe"), "word", "n")
    probes = placed.select(*group, every("xs").alias("x"), block_of("ys").alias("y"), F.lit(True).alias("probe"), "word", "n")
    # Few bytes, much work: not fewer tasks than the session asks for.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = index.union(probes).repartition(tasks, *group, "x", "y").sortWithinPartitions(*group, "x", "y", "probe")
    return rows.mapInArrow(_merged, _PAIRS).distinct()


def variant_forms(words: DataFrame, ratio: int = 5, block: int = _BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words.

    Two words are near if one inserted, deleted or replaced code point turns one into the other; n_near counts them. form
    is the near word of the largest n (ties: the smallest in code-point order) if that n is at least ratio times the
    word's own, else null; root follows forms to the last one, and is the word itself where there is none.

    ratio must be a whole number above 1, so that n grows along forms and no chain is longer than the logarithm of the largest n. Null
    words are left out; no words give no rows.
    """
    if ratio <= 1 or ratio != int(ratio):
        raise ValueError("ratio must be a whole number above 1: forms could go in circles")
    need(words, ["word", "n"])
    words = cut(words.filter("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "words")
    pairs = cut(near_pairs(words, block), "near")
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "other", "other_n")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    large = F.col("n") <= F.expr(f"-best.minus div {ratio:d}")  # n * ratio could overflow
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n")
    )
    found = cut(found, "forms")
    step, changed = found.filter("form is not null").select("word", F.col("form").alias("root")), 1
    for k in range(math.ceil(math.log2(64 / math.log2(ratio))) + 1):  # each round doubles how far a root is followed
        if not changed:
            break
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step, seen = cut_with(
            step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            f"roots{k}", moved=F.count_if("moved"),
        )
        step, changed = step.drop("moved"), seen["moved"]
    return found.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, ratio: int = 5, slip_every: int | None = None
) -> DataFrame:
    """variant_forms() of the words of whole texts: maximal runs of letters, A-Z lower-cased, long and frequent enough.

    slip_every plants slips: where it divides the hash of id and run, one code point of the run is left out. Null and
    empty texts have no words; rows that repeat an id or a text count each time; columns besides the two named are
    ignored, whatever their names. An empty table gives no rows.
    """
    need(docs, [id_col, text_col])
    runs = word_runs(docs, id_col, text_col, least_chars)
    word = with_slips(runs, slip_every) if slip_every else F.col("run")
    return variant_forms(counted(runs.select(word.alias("word")), least_chars, least_n), ratio)
