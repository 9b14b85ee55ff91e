"""The pipeline against a plain Python version of its five stages, and its stages one by one."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as p
from flowlens.llm import pii, quality, queries
from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_edges import verdict
from tests.llm.test_operators import brute_components, check_packing, split_words


def plain_lines(rows):
    """Lines on eight sites or more go but for their first copy; so do documents that lose all their lines."""
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for k, line in enumerate((text or "").split("\n")):
            if split_words(line):
                key, at = line.strip(" "), (i is not None, i or 0, k)
                sites[key] |= {site} - {None}
                first[key] = min(first.get(key, at), at)
    out = []
    for i, text, site in rows:
        lines = (text or "").split("\n")
        gone = {k for k, x in enumerate(lines) if split_words(x) and len(sites[x.strip(" ")]) >= 8 and first[x.strip(" ")] != (i is not None, i or 0, k)}
        if not gone or len(gone) < sum(bool(split_words(x)) for x in lines):
            out.append((i, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), site))
    return out


def plain_run(spark, rows):
    """(id, text) after the first four stages; masking is that of the operator, whose spans have their own brute force."""
    rows = [r for r in rows if verdict(r[1], quality.Bands())]
    rows = plain_lines(rows)
    roots = brute_components([(i, t) for i, t, _ in rows])
    rows = [(i, t) for i, t, _ in rows if roots[i][1] == i]
    masked = pii.masked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r.doc_id: r.text for r in masked}


def test_run_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(r[0], r[1], r[3]) for r in documents() if r[0] is not None]
    spark.createDataFrame([r for r in documents() if r[0] is not None], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    left = plain_run(spark, rows)
    got = p.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for i, text in left.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(-(-len(ids) // 2048)):
            part = ids[k * 2048 : (k + 1) * 2048]
            want[(i, k, k * 2048, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 0 < len(left) < len(rows)
    bins, least = check_packing(got, left, library)  # gapless offsets, lengths, checksums
    assert bins <= least + 2


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = p.cut(out, name)
    assert all(r.spans == "" for r in pii.pii_report(docs).collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
