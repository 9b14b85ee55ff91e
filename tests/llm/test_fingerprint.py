"""Fingerprints against an Order MinHash in plain Python, hash by hash."""

import hashlib
import random
import re

import numpy as np
import xxhash

from flowlens.llm import fingerprint
from tests.llm.fixtures import documents

MASK = (1 << 63) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*values):
    """Spark's xxhash64 of columns: each value's hash seeds the next one's; null leaves it as it is."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain_sketch(text, k=3, slots=64):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    if not tokens:
        return None
    grams = [tuple(tokens[i + j] if i + j < len(tokens) else None for j in range(k)) for i in range(max(1, len(tokens) - k + 1))]
    count, cells = {}, {}
    for at, gram in enumerate(grams):
        count[gram] = count.get(gram, 0) + 1
        g = chain((chain(*gram), 8), (count[gram], 4))
        cell = g % (2 * slots)
        if cell not in cells or g < cells[cell][0]:
            cells[cell] = (g, at)
    filled, out = sorted(cells), []
    for s in range(slots):
        first = next((i for i, c in enumerate(filled) if c >= 2 * s), 0)
        two = [cells[filled[first]], cells[filled[(first + 1) % len(filled)]]]
        two.sort(key=lambda x: x[1])
        out.append(chain((two[0][0], 8), (two[1][0], 8)) & 0x7FFFFFFF)
    return out


def hexed(sketch):
    return "." * 512 if sketch is None else "".join(f"{x:08x}" for x in sketch)


def alike(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def expected(rows):
    """(id, n_chars, edited hash, fingerprints, likenesses) of each row, from documents in order of id, length and hash."""
    def key(r):
        text = r[1] or ""
        return (r[0] is not None, r[0] or 0, len(text), chain(text))

    ring = sorted(set((r[0], r[1] or "") for r in rows), key=key)
    out = []
    for i, t in [(r[0], r[1] or "") for r in rows]:
        after = ring[(ring.index((i, t)) + 1) % len(ring)][1]
        need = len(t) // 4
        edited = t[: len(t) - need] + after[:need]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in df.collect()), key=repr)


def test_against_plain_python(spark):
    rnd = random.Random(12)
    rows = [r[:2] for r in documents()]
    rows += [(1000 + k, " ".join(rnd.choice("abc") for _ in range(n))) for k, n in enumerate((1, 2, 3, 4, 5, 9, 30, 200, 900))]
    rows += [(2000 + k, "to be or not to be " * n) for k, n in enumerate((1, 2, 50))]
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(60_000))
    rows += [(3000, long), (3001, "x" * 50_000), (3002, "x" * 50_000 + " " + long[:9000])]
    rows += [(7, "another text under a used id"), (7, "and one more of them"), (22, "first copy of a row"), (22, "first copy of a row"), (None, "second text without an id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    clash = df.selectExpr("*", "doc_id as id", "text as h", "1 as n", "2 as times", "'x' as next", "3 as cell")
    assert found(fingerprint.fingerprints(clash)) == expected(rows)


def test_one_row_and_none(spark):
    for rows in ([], [(5, "one two three four")], [(None, None)], [(1, "a b c d"), (1, "a b c d")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert found(fingerprint.fingerprints(df)) == expected(rows)


def test_order_counts_in_short_texts(spark):
    """Every slot of a text with two k-mers holds a pair, so moving a part of a short text is seen too."""
    rnd = random.Random(3)
    shares = []
    for _ in range(40):
        w = [f"t{rnd.randrange(10**6)}" for _ in range(60)]
        a, b = plain_sketch(" ".join(w)), plain_sketch(" ".join(w[30:] + w[:30]))
        shares.append(np.mean([x == y for x, y in zip(a, b, strict=True)]))
    assert 0.3 < np.mean(shares) < 0.7  # of the same k-mers about half of the pairs stand in another order
