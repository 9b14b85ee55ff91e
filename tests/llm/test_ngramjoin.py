"""The n-gram Jaccard join against all pairs in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from flowlens.llm import ngramjoin, queries
from tests.llm.fixtures import SCHEMA, documents

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k=3, percent=90):
    """(id, size, component) of every row, and how many pairs of different sets are linked."""
    sets = []
    for _, t in rows:
        w = [x.translate(UP) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    holders, parent, links = defaultdict(list), list(range(len(rows))), 0

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in holders[g]:
                both[j] += 1
            holders[g].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links += s != sets[j]
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), doc_id) if x is not None), default=None)
    return sorted(((doc_id, len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(rows)), key=repr), links


def joined(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, node int, component_id string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.ngram_links(docs.repartition(3), **how).collect()), key=repr)


def families(seed, lengths=(12, 20, 60, 150, 400), n=7, each=40):
    """Copies of a text and of its copies, most of them just about as far apart as the limit; and texts of a few words."""
    rnd, rows = random.Random(seed), []

    def add(w):
        rows.append((len(rows) * 2 + 1, " ".join(w)))

    for _ in range(n):
        base = [f"v{rnd.randrange(3000)}" for _ in range(rnd.choice(lengths))]
        last = base
        for _ in range(each):
            w = list(base if rnd.random() < 0.6 else last)
            for _ in range(rnd.randrange(max(2, len(w) // 25))):
                j = rnd.randrange(len(w))
                w[j : j + rnd.randrange(2)] = [f"v{rnd.randrange(3000)}" for _ in range(rnd.randrange(2))]
            last = w
            add(w)
    for size in range(1, 14):
        for _ in range(5):
            add([rnd.choice("abC") for _ in range(size)])
    return rows


@pytest.mark.parametrize(("block", "percent"), [(1024, 90), (8, 90), (1024, 75)])
def test_families(spark, monkeypatch, block, percent):
    monkeypatch.setattr(ngramjoin, "_BLOCK", block)
    rows = families(block + percent)
    want, links = brute(rows, percent=percent)
    assert joined(spark, rows, percent=percent) == want
    assert links > 300


def test_centre_is_linked_with_no_one(spark):
    """Copies that are all too far from their original but partly near each other: only the trees can find those links."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in rnd.sample(range(0, 300, 4), 11):  # 33 of 298 shingles replaced: a similarity of 0.80 with the original
            w[j] = f"r{k // 3}.{j}"
        for j in rnd.sample(range(2, 300, 4), 1):
            w[j] = f"own{k}"
        rows.append((k + 1, " ".join(w)))
    # three copies each get the same replacements: near each other
    for k in range(1, 61, 3):
        one = rows[k][1].split()
        for m in (1, 2):
            w = list(one)
            w[rnd.randrange(300)] = f"more{k}.{m}"
            rows[k + m] = (k + m, " ".join(w))
    want, links = brute(rows)
    assert links == 60 and {c for i, _, c in want if i} == set(range(1, 61, 3))
    assert joined(spark, rows) == want


def test_hot_passage_links_no_one(spark):
    rnd = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} {' '.join(f'q{rnd.randrange(10**6)}' for _ in range(rnd.randrange(20, 90)))}") for k in range(120)]
    want, links = brute(rows)
    assert links == 0 and joined(spark, rows) == want


def test_fixture_and_odd_rows(spark):
    rows = [(r[0], r[1]) for r in documents()]
    long = " ".join(f"l{k}" for k in range(30_000))
    rows += [(901, long), (902, long + " end"), (902, "another text of the same id"), (None, "a row without an id but with words in it"), (5000, "only this row has an id here"), (None, "only this row has an id here")]
    got, (want, _) = joined(spark, rows), brute(rows)
    assert got == want
    assert (None, 5, 5000) in got and got.count((None, 8, None)) == 2  # an id before no id
    assert not joined(spark, [])
    for bad in (49, 100):
        with pytest.raises(ValueError):
            ngramjoin.ngram_links(spark.createDataFrame([], SCHEMA), percent=bad)


def test_parts_lose_no_pair():
    """Sets as far apart as the limit allows have a key in common, at sizes around the ends of ranges and with empty parts."""
    rnd = np.random.default_rng(3)
    ends = [s for low, high, _ in ngramjoin.ranges(90, 3000) for s in (low, high)]
    for n in sorted({*ends, *range(9, 60)}):
        for extra in (0, n // 9, n // 18):  # y has so many elements that x lacks; and as many of x are missing as may be
            x = rnd.integers(1, 1 << 63, n, dtype=np.uint64)
            lost = next(k for k in range(n, -1, -1) if 100 * (n - k) >= 90 * (n + extra)) if 100 * n >= 90 * (n + extra) else None
            if lost is None:
                continue
            y = np.concatenate([x[lost:], rnd.integers(1, 1 << 63, extra, dtype=np.uint64)])
            if lost + extra:
                assert np.intersect1d(ngramjoin.part_keys(np.sort(x), 90), ngramjoin.part_keys(np.sort(y), 90)).size, (n, extra, lost)


def test_tree_finds_all_and_only_links():
    rnd = random.Random(2)
    for trial in range(60):
        whole = [rnd.sample(range(1, 40), rnd.randrange(1, 14)) for _ in range(rnd.randrange(1, 40))]
        centre = set(rnd.sample(range(1, 40), 10))
        sets = list({frozenset(s) for s in whole} - {frozenset(centre)})
        differs = [np.array(sorted(set(s) ^ centre), dtype=np.uint64) for s in sets]
        sizes, groups = np.array([len(s) for s in sets]), np.array([rnd.randrange(5) for _ in sets])
        for percent in (50, 60, 75):
            tree = ngramjoin.PrefixTree(differs, sizes, groups, percent)
            for i, s in enumerate(sets):
                want = {j for j, t in enumerate(sets) if groups[i] != groups[j] and 100 * len(s & t) >= percent * len(s | t)}
                assert set(tree.linked(differs[i], len(s), groups[i]).tolist()) == want, (trial, percent)


def test_smallest_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op12_prefix_tree_join(spark, sf).collect()), key=repr)
    assert got == brute(rows)[0]
