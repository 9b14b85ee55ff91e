"""The queries of the thirteen operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import arcwarc, bpe, fingerprint, infill, langid, linededup, neardup, ngramjoin, packing, pii, quality, tokencount, variants
from flowlens.llm.common import dealt, table


def tokenizer_file(name: str) -> str:
    """A file of the public tokenizers; FLOWLENS_TOKENIZERS names another folder."""
    folder = os.environ.get("FLOWLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(dealt(table(spark, sf_dir, "documents")))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(dealt(table(spark, sf_dir, "documents")))


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(dealt(table(spark, sf_dir, "documents")))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select(
        "doc_id", "n_lines", "n_removed",
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("clean_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"),
    )


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcwarc.archived_pages(table(spark, sf_dir, "pages"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(dealt(table(spark, sf_dir, "documents")), tokenizer_file("word_bpe_49k.json"))


def op8_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    return bpe.round_trips(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


def op10_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(dealt(table(spark, sf_dir, "documents")), tokenizer_file("piece_bpe_32k.model"))


def op11_qgram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.document_variants(dealt(table(spark, sf_dir, "documents")), slip_every=199)


def op12_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_links(dealt(table(spark, sf_dir, "documents")))


def op13_lookaround_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(dealt(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_order_minhash, op2_pii, op3_compression_bands, op4_bbit_minhash, op5_line_spread, op6_arc_to_warc,
        op7_best_two_fit, op8_compression_language, op9_forced_boundary_bpe, op10_resync_token_counts,
        op11_qgram_variants, op12_prefix_tree_join, op13_lookaround_infill,
    )
    return {f.__name__: f for f in ops}


_OP5 = r"""
WITH lines AS (
  SELECT doc_id, source, line, pos FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           unnest(range(0, len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), spread AS (
  SELECT trim(line, ' ') AS line, min(struct_pack(doc_id := doc_id, pos := pos)) AS head
  FROM lines GROUP BY 1 HAVING count(DISTINCT source) >= 8
), gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN spread s ON trim(l.line, ' ') = s.line
  WHERE l.doc_id <> s.head.doc_id OR l.pos <> s.head.pos
), per_doc AS (
  SELECT doc_id, list(pos) AS positions FROM gone GROUP BY 1
), clean AS (
  SELECT d.doc_id, d.text AS raw, CASE WHEN g.positions IS NULL THEN coalesce(d.text, '') ELSE array_to_string(
           [x.line FOR x IN list_zip(string_split(d.text, chr(10)), range(0, len(string_split(d.text, chr(10))))) IF NOT list_contains(g.positions, x[2])], chr(10)) END AS text,
         len(coalesce(g.positions, [])) AS n_removed
  FROM documents d LEFT JOIN per_doc g USING (doc_id)
)
SELECT doc_id,
       coalesce(len(list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)::BIGINT AS n_lines,
       n_removed::BIGINT AS n_removed, length(text)::BIGINT AS clean_chars, sha256(text) AS clean_sha256
FROM clean
""".replace("[x.line FOR", "[x[1] FOR")

_OP6 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.head < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.head < p.page_id THEN f.head END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


_OP11 = """
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT b, c FROM bits WHERE k = 8), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), keyed AS (
  SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS h FROM runs WHERE length(run) >= 6 GROUP BY 1, 2
), crc AS (
  SELECT doc_id, run, n, h, 0::BIGINT AS i, 4294967295::BIGINT AS c FROM keyed
  UNION ALL
  SELECT doc_id, run, n, h, i + 1, xor(crc.c >> 8, t.c) FROM crc JOIN crc_table t ON t.b = xor(crc.c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE 2 * i < length(h)
), hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM crc WHERE 2 * i = length(h)), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.head || x.tail = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.head || x.tail = y.word
), near AS (
  SELECT word, count(*) AS n_near, min({'minus': -other_n, 'other': encode(other)}) AS best FROM pairs GROUP BY 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.minus >= 5 * w.n THEN decode(best.other) END AS form, CASE WHEN -best.minus >= 5 * w.n THEN -best.minus END AS form_n
  FROM words w LEFT JOIN near USING (word)
), followed AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT f.word, g.form FROM followed f JOIN forms g ON f.at = g.word WHERE g.form IS NOT NULL
), roots AS (SELECT f.word, f.at AS root FROM followed f JOIN forms g ON f.at = g.word WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

_OP12 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id < y.doc_id
  WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90 GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM ends UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.other = ends.a
), low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(low.other, s.doc_id) AS component_id FROM s LEFT JOIN low USING (doc_id)
"""

_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), e AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS p1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS p2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), f AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:least(p1, p2)], '') AS p, array_to_string(u[least(p1, p2) + 1:greatest(p1, p2)], '') AS m,
         array_to_string(u[greatest(p1, p2) + 1:], '') AS s FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_spread": _OP5, "op6_arc_to_warc": _OP6, "op11_qgram_variants": _OP11, "op12_prefix_tree_join": _OP12, "op13_lookaround_infill": _OP13}
