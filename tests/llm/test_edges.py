"""Repeated ids, clashing column names, very long texts, and brute force where test_operators.py has none."""

import random
import zlib
from collections import Counter

import pytest
import zstandard

import corpus_pipeline as p
from flowlens.llm import linededup, langid, neardup, pii, quality, queries, tokencount
from tests.llm.fixtures import SCHEMA, words
from tests.llm.test_operators import brute_components, split_words


def table(spark, rows):
    """Documents (id, text, source) with the other columns filled in."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def near(text, rnd, changes=3):
    w = text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"y{rnd.randrange(10**6)}"
    return " ".join(w)


# --- repeated ids: rows are decided by their own text ------------------------------------------------------------


def test_near_dedup_repeated_ids(spark):
    rnd = random.Random(1)
    base, other, third = (words(rnd, 200, 10**6) for _ in range(3))
    copy = near(base, rnd)
    rows = [(1, base), (5, copy), (5, other), (7, third), (7, third), (None, near(base, rnd)), (None, "a text of its own that has no id"), (9, None), (9, None), (9, " ")]
    got = texts(p.near_dedup(spark, table(spark, [(i, t, "s") for i, t in rows]), ""))
    assert got == Counter([(1, base), (5, other), (7, third), (None, "a text of its own that has no id"), (9, None), (9, None), (9, " ")])
    found = neardup.near_duplicates(table(spark, [(i, t, "s") for i, t in rows]))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found.filter("doc_id in (5, 7)").collect()) == [(5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True)]
    assert sum(r.stays for r in found.filter("doc_id = 7").collect()) == 1


def test_near_dedup_nulls_only(spark):
    text = "these five words and more"
    got = p.near_dedup(spark, table(spark, [(None, text, "s"), (None, text, "t"), (None, None, None)]), "").collect()
    assert sorted(str(r.text) for r in got) == ["None", text]


def test_line_dedup_repeated_ids(spark):
    footer = "the footer of all sites"
    rows = [(k, f"{footer}\nown line {k}", f"s{k}") for k in range(1, 10)]
    rows += [(10, f"{footer}\nmore", "s1"), (10, "precious words\nmore", "s2"), (10, "precious words\nmore", "s2"), (None, f"{footer}\nno id", None)]
    got = texts(p.line_dedup(spark, table(spark, rows), ""))
    want = [(k, f"own line {k}") for k in range(1, 10)] + [(10, "more"), (10, "precious words\nmore"), (10, "precious words\nmore")]
    assert got == Counter([*want, (None, f"{footer}\nno id")])  # a null id comes first, so its copy stays


# --- column names ------------------------------------------------------------------------------------------------

HELPERS = [
    "has_digit", "pii_text", "pii_spans", "pii_email", "pii_iban", "raw_text", "gone_positions", "gone_id", "gone_th", "positions", "th", "n_lines", "n_removed", "row", "node", "id", "site", "pos",
    "h1", "key", "head", "rep", "comp", "line", "N_WORDS", "kept", "stays", "text_", "a.b", "we`ird", "block", "piece",
]


def test_extra_columns_pass_through(spark):
    rnd = random.Random(2)
    clean = "\n".join(words(rnd, 30, 10**5) for _ in range(3))
    rows = [(k, f"{clean} {words(rnd, 90, 10**6)} mail bob{k}@x.yz\nthe footer of all sites", f"s{k}") for k in range(9)]
    df = table(spark, rows)
    for k, name in enumerate(HELPERS):
        df = df.withColumn(name, df.doc_id * 100 + k)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        got = out.collect()
        assert len(got) == 9 and all(r[c] == r.doc_id * 100 + k for r in got for k, c in enumerate(HELPERS)), name
        if name == "mask_pii":
            assert all("[EMAIL]" in r.text and "bob" not in r.text and r.n_chars == len(r.text) for r in got)
    assert p.best_fit_packing(spark, df, "").count() == 9


# --- personal data -----------------------------------------------------------------------------------------------


def iban(country, length, rnd):
    body = "".join(rnd.choice("0123456789") for _ in range(length - 4))
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def test_ibans_by_country(spark):
    rnd = random.Random(5)
    rows, k = [], 0
    for length, countries in pii.IBAN_LENGTHS.items():
        for c in countries.split():
            number = iban(c, length, rnd)
            spaced = " ".join(number[i : i + 4] for i in range(0, length, 4))
            for form in (number, spaced):
                for after in ("", " BANK", " AND account", ", then", " 12"):
                    rows.append((k, f"IBAN {form}{after}", form))
                    k += 1
    wrong = iban("DE", 22, rnd)
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    rows.append((k, f"IBAN {wrong} BANK", None))
    assert len({r[2][:2] for r in rows[:-1]}) > 70
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    for r in pii.masked(df).collect():
        assert (r.form is None) == ("[IBAN]" not in r.text), r
        assert r.form is None or r.form not in r.text, r


def test_masking_long_text(spark):
    rnd = random.Random(6)
    parts, want = [], []
    for k in range(4000):
        gap = "é😀 " * rnd.randrange(1, 60)
        parts.append(f"{gap}u{k}@host{k}.org")
        want.append(f"{gap}[EMAIL]")
    tail = " end " * 2000
    [got] = pii.masked(spark.createDataFrame([(1, "".join(parts) + tail)], "doc_id bigint, text string")).collect()
    assert got.text == "".join(want) + tail


# --- long texts --------------------------------------------------------------------------------------------------


def test_near_duplicates_beyond_a_segment(spark):
    """Texts of more than 1 MiB, whose words are hashed in several segments."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**7)}" for _ in range(180_000)]
    assert len(" ".join(base)) > 1 << 20
    changed = list(base)
    for _ in range(5000):
        changed[rnd.randrange(len(base))] = f"z{rnd.randrange(10**7)}"
    rows = [(1, " ".join(base)), (2, "\n".join(changed)), (3, " ".join(base[:90_000])), (4, "short text of five words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_line_dedup_long_text(spark):
    long = "\n".join(f"line {k}\nthe footer of all sites" for k in range(20_000))
    rows = [(k, f"the footer of all sites\nown {k}", f"s{k}") for k in range(8)] + [(100, long, "s9")]
    got = {r.doc_id: r for r in linededup.without_boilerplate(table(spark, rows)).collect()}
    assert got[100].text == "\n".join(f"line {k}" for k in range(20_000)) and got[100].n_removed == 20_000


def test_token_counts_of_long_text(spark):
    """Several chunks at the default size: the splices must give the library's count."""
    path = queries.tokenizer_file("piece_bpe_32k.model")
    counter = tokencount.counter(path)
    rnd = random.Random(8)
    rows = [(1, " ".join(rnd.choice(["river", "stone", "ébène", "12", "the", "日本", "x" * 9]) for _ in range(60_000))), (2, "a" * 70_000), (3, " ".join(["word"] * 20_000))]
    assert all(len(t) > 3 * tokencount.CHUNK for _, t in rows)
    for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect():
        assert r.n_tokens == len(counter.model.encode(dict(rows)[r.doc_id]))


# --- brute force -------------------------------------------------------------------------------------------------


def verdict(text, bands):
    """The rules restated with plain zstandard."""
    data = (text or "").encode()
    w = split_words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered |= {k, k + 1, k + 2}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return False

    def ratio(part):
        return len(part) / len(zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress(part))

    def pieces(size):
        if len(data) <= size:
            return []
        whole = [data[k : k + size] for k in range(0, len(data) - size + 1, size)]
        return whole if len(data) % size == 0 else [*whole, data[-size:]]

    least, most = [(a, b) for start, a, b in bands.document if len(data) >= start][-1]
    chunks, small = [ratio(c) for c in pieces(bands.chunk)], [ratio(c) for c in pieces(bands.piece)]
    return (
        least <= ratio(data) <= most
        and sum(r > bands.chunks[1] for r in chunks) <= bands.share * len(chunks)
        and sum(r < bands.chunks[0] for r in chunks) <= bands.noise_share * len(chunks)
        and sum(r < bands.piece_least for r in small) <= bands.noise_share * len(small)
    )


def test_quality_verdict(spark):
    rnd = random.Random(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    stock = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(900)]
    for k in range(60):
        prose = " ".join(rnd.choices(stock, k=rnd.randrange(40, 3000)))
        noise = " ".join("".join(rnd.choices("ABCDEFGHabcdefgh0123456789+/xyzXYZ", k=12)) for _ in range(rnd.randrange(0, 400)))
        rows.append((10_000 + k, rnd.choice([prose + " " + noise, noise + " " + prose, prose, prose[:300] + prose[:300] * (k % 3)])))
    rows += [(20_000, None), (20_000, rows[0][1]), (20_000, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter((i, verdict(t, quality.Bands())) for i, t in rows)
    assert Counter((r.doc_id, r.kept) for r in quality.quality(df).collect()) == want
    assert texts(quality.passing(df)) == Counter((i, t) for i, t in rows if verdict(t, quality.Bands()))
    assert quality.passing(df.filter("false")).count() == 0


def test_language_by_plain_compression(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    settings = langid.Settings()
    rows = langid.sample(frame, settings).collect()
    by_id = {r.text for r in frame.collect()}
    assert all(r.text in by_id for r in rows)  # whole texts
    assert max(Counter(r.lang for r in rows).values()) <= settings.sample_docs
    held = {r.text for r in frame.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1} - {r.text for r in frame.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert not held & {r.text for r in rows}
    coders = []
    for lang in sorted({r.lang for r in rows}):
        raw = "\n".join(r.text for r in sorted(rows, key=lambda r: (r.lang, r.rank)) if r.lang == lang).lower().encode()
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders.append((lang, d))
    for r in langid.languages(frame.union(frame.limit(2))).collect():
        data = next(x.text for x in frame.collect() if x.doc_id == r.doc_id).lower().encode() if r.doc_id % 17 == 0 else None
        if data:
            sizes = []
            for lang, d in coders:
                code = zstandard.ZstdCompressor(level=settings.level, dict_data=d, write_content_size=False, write_dict_id=False)
                sizes.append((sum(len(code.compress(data[k : k + settings.chunk])) for k in range(0, len(data), settings.chunk)), lang))
            sizes.sort()
            assert r.lang_pred == sizes[0][1] and r.score == pytest.approx(1 - sizes[0][0] / sizes[1][0])
