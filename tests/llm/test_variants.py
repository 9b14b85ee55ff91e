"""Spelling variants against a deletion-neighbourhood version in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from flowlens.llm import queries, variants

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "word string, n bigint"


def brute(words, ratio=5):
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in words and len(x) > 1:
                near[w].add(x), near[x].add(w)
    for same in holes.values():
        for x in same if len(same) > 1 else ():
            near[x] |= same - {x}
    form = {}
    for w in words:
        best = min(near[w], key=lambda y: (-words[y], y), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(seed, n=900):
    """Families of words one and two edits from each other, with repeated letters, accents and letters beyond the BMP."""
    rnd, words = random.Random(seed), {}
    for _ in range(n // 30):
        base = "".join(rnd.choice("abñé𝒳" if rnd.random() < 0.5 else "abcdefghijkl") for _ in range(rnd.randrange(2, 14)))
        for _ in range(30):
            w = base
            for _ in range(rnd.randrange(3)):
                i = rnd.randrange(len(w) + 1)
                w = rnd.choice((w[:i] + rnd.choice("abcé𝒳") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcé") + w[i + 1 :]))
            if len(w) > 1:
                words[w] = rnd.choice((5, 6, 25, 30, 125, 700, 5000))
    return words


@pytest.mark.parametrize("block", [2048, 8])
def test_forms_by_brute_force(spark, block):
    words = vocabulary(block)
    got = found(variants.variant_forms(spark.createDataFrame(list(words.items()), WORDS).repartition(3), block=block))
    want = brute(words)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and max(v[3] for v in want.values()) > 10


def test_pairs_come_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaabaa", "aaaaab", "abaaaa", "zzzzzz", "zzzzz"]
    got = Counter(frozenset((r.a, r.b)) for r in variants.near_pairs(spark.createDataFrame([(w, 1) for w in words], WORDS)).collect())
    want = {frozenset((x, y)) for x in words for y in words if x != y and (variants.one_edit(x, y) or variants.one_edit(y, x))}
    assert set(got) == want and set(got.values()) == {1}


def test_longest_chain(spark):
    """A chain of forms about as long as n allows: 26 words, each five times as frequent as the one before."""
    words = {"a" * (k + 6): 5 ** (k + 1) for k in range(26)}
    got = found(variants.variant_forms(spark.createDataFrame(list(words.items()), WORDS)))
    assert got == brute(words) and {v[1] for v in got.values()} == {"a" * 31}


def test_ties_nulls_and_short_words(spark):
    words = [("kitten", 5), ("kittén", 25), ("kittan", 25), (None, 9), ("a", 9), ("b", 900), ("ab", 9), ("", 50)]
    got = found(variants.variant_forms(spark.createDataFrame(words, WORDS)))
    assert got["kitten"] == ("kittan", "kittan", 5, 2, 25)  # of equal n the smaller in code-point order
    assert got["a"] == (None, "a", 9, 0, None) and got[""] == (None, "", 50, 0, None) and None not in got
    assert not found(variants.variant_forms(spark.createDataFrame([], WORDS)))
    with pytest.raises(ValueError):
        variants.variant_forms(spark.createDataFrame([], WORDS), ratio=1)


def counted(rows, slip_every):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip_every and h % slip_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


@pytest.mark.parametrize("slip_every", [None, 3])
def test_documents(spark, slip_every):
    rnd = random.Random(4)
    stock = ["Straßen", "straßen", "STRAßEN", "étranger", "ÉTRANGER", "letters", "letter", "lettres", "colour", "color's", "x×y÷zabc", "日本語letters"]
    rows = [(k % 40, " ,\n".join(rnd.choice(stock) for _ in range(rnd.randrange(60)))) for k in range(60)]
    rows += [(None, None), (None, "letters letters"), (7, ""), (8, "12 34"), (9, "a" * 100_000 + " letters " * 30_000)]
    docs = spark.createDataFrame([(i, t, "word", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    got = found(variants.document_variants(docs, slip_every=slip_every))
    assert got == brute(counted(rows, slip_every)) and len(got) > 6
    assert not found(variants.document_variants(docs.limit(0)))


def test_smallest_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.op11_qgram_variants(spark, sf)) == brute(counted(rows, 199))
