"""Fill-in-the-middle texts against a cutter in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from flowlens.llm import infill, queries
from tests.llm.fixtures import SCHEMA, documents

UNITS = {
    "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "words_then_space": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
    "characters": r"(?s).",
}


def made(doc_id, text, grammar="words", percent=50, spm_percent=80):
    text = text or ""
    u = re.findall(UNITS[grammar], text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < spm_percent:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rnd = random.Random(6)
    texts = [None, "", " ", "\n", "a", " a", "a ", "\x0b\x0c a\x1cb\x85c d　e \r\n f\t", "😀 😀😀\n😀", "é x", "a <P> mark", "<S>", "x<M", "<<P", "<P <S", ">M> <", "x " * 40_000, "y" * 90_000, " nbsp "]
    texts += ["".join(rnd.choice("ab <>PSM\n\t é😀") for _ in range(rnd.randrange(60))) for _ in range(200)]
    return texts


@pytest.mark.parametrize("grammar", list(UNITS))
def test_by_plain_python(spark, grammar):
    rows = [(k - 1 if k else None, t) for k, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = infill.fill_in_middle(docs, grammar=grammar, percent=90).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    forms = set()
    for r in out.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == made(r.doc_id, r.text, grammar, 90), (r.doc_id, r.text)
        assert r.back == (r.text or "")
        forms.add(r.form)
    assert forms == {"plain", "spm", "psm"}


@pytest.mark.parametrize("grammar", list(infill.GRAMMARS))
def test_units_joined_are_the_text(spark, grammar):
    docs = spark.createDataFrame([(t,) for t in odd_texts()], "text string").select("text", infill.units(F.col("text"), grammar).alias("u"))
    for r in docs.collect():
        assert "".join(r.u) == (r.text or "") and "" not in r.u
        if grammar in UNITS:
            assert r.u == re.findall(UNITS[grammar], r.text or "")


def test_runs(spark):
    [r] = spark.range(1).select(infill.units(F.lit("Añ1_b  !!?c\n"), "runs").alias("u")).collect()
    assert r.u == ["Añ1_b", "  ", "!!?", "c", "\n"]
    with pytest.raises(ValueError):
        infill.boundary("sentences")


def test_columns_repeats_and_empty(spark):
    rows = [(1, "one two three", 5, "x"), (1, "one two three", 6, "y"), (1, "four", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, done int, N string")
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "done", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((r.done, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == [(5, *made(1, "one two three")), (6, *made(1, "one two three")), (7, *made(1, "four"))]
    assert not infill.fill_in_middle(docs.limit(0)).collect()
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs.withColumnRenamed("text", "output"), text_col="output")


def test_query(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *(m := made(i, t))[:4], sha(m[4]), sha(t or "")) for i, t, *_ in rows), key=repr)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in queries.op13_lookaround_infill(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
