"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, PII masking, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import linededup, neardup, packing, pii, quality
from flowlens.llm.common import cut, dealt, named, spare, table
from flowlens.llm.queries import tokenizer_file

#: SQL cannot express the stages; tests/llm holds the whole against a plain Python version of them.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have too few words and go. Each row is judged alone and whole, so repeated rows and ids stay or
    go together; an empty table stays empty. Columns pass through, whatever their names.
    """
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; n_chars follows the text. Documents of which no word is left go too.

    A document is an id with a text: rows that repeat both lose the same lines, another text under the same id is
    another document. Null texts, null ids and null sites are no reason to drop a row. Texts are taken whole; columns
    pass through, whatever their names, and an empty table stays empty.
    """
    lines, removed = spare(docs, "n_lines", "n_removed")
    clean = linededup.without_boilerplate(docs, lines_as=lines, removed_as=removed)
    emptied = (named(removed) > 0) & (named(removed) == named(lines))
    counted = F.when(named(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.filter(~emptied).withColumn("n_chars", counted).select(*[named(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest id (null last; of repeated rows any one).

    Rows are numbered and decided one by one: rows that repeat id and text are copies of which one stays, another text
    under the same id goes by its own words. Documents without words, null texts among them, all stay. Texts are read
    whole; columns pass through, whatever their names, and an empty table stays empty.
    """
    [row] = spare(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(numbered, row_col=row)
    gone = cut(found.filter(~F.col("stays")).select(F.col("row").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*[named(c) for c in docs.columns])


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text.

    Null texts stay null, texts without spans are not touched. Each row is masked alone and whole, so repeated rows and
    ids do no harm; other columns pass through, whatever their names, and an empty table stays empty.
    """
    [raw] = spare(docs, "raw_text")
    masked = pii.masked(docs.withColumn(raw, F.col("text")))
    changed = ~F.col("text").eqNullSafe(named(raw))
    counted = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", counted).select(*[named(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place in it.

    Null and empty texts are a piece of one end id. Only documents longer than a sequence are cut. Rows that repeat an
    id are packed each on its own; other columns are ignored, and an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = dealt(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
