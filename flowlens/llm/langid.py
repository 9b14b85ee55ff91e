"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is the raw text of a bounded, hash-ordered sample of labelled training rows, each of them whole.
A text is compressed in fixed chunks with every dictionary (a dictionary helps near the start only, so chunks keep it at
work through a long text), and the total sizes are compared over the whole text, in lower case. Where the two smallest are
close the decision is not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import named, need, ship

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """Bound of the training sample, compression, and the least relative margin of an accepted decision."""

    sample_docs: int = 150  # labelled rows a language; the dictionary is all their text
    sample_bytes: int = 4 << 20  # UTF-8 bytes a language: whole rows are taken while they fit
    most_langs: int = 100  # a table with more language values is refused; sample_bytes times this is what the driver may hold
    short_bytes: int = 1000  # rows of up to so many bytes are taken first, longer ones by rising length
    level: int = 6
    chunk: int = 8192
    margin: float = 0.02


def held_out(id_col: str) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, text): at most sample_docs whole texts and sample_bytes of each language, the first in hash order.

    Short rows come first: a dictionary of many short texts shows more of a language than a few long ones of the same size,
    and a bound in bytes would else be used up by the first long text. A language all of whose texts are larger than
    sample_bytes teaches nothing. More than most_langs values of the column are an error that names the setting to raise.

    Counts by language, over narrow columns, say below which hash a row may be among the first; so only some sixteen times
    as many rows as are wanted come to the window, at any number of rows and partitions.
    """
    need(docs, [id_col, text_col, lang_col])
    h = F.xxhash64(F.lit(17), named(id_col))
    known = docs.filter(named(lang_col).isNotNull() & ~held_out(id_col))
    counts = known.groupBy(named(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("rows"))
    if counts.limit(settings.most_langs + 1).count() > settings.most_langs:
        raise ValueError(f"there are more than {settings.most_langs} languages: raise Settings.most_langs, and the driver's memory by sample_bytes for each")
    rows = known.filter(named(text_col).isNotNull()).select(
        named(lang_col).alias("lang"), h.alias("h"), named(id_col).alias("id"), named(text_col).alias("text")
    )
    early = F.pmod("h", F.lit(1 << 32)) / F.lit(float(1 << 32)) * F.col("rows") < 16 * settings.sample_docs
    order = Window.partitionBy("lang").orderBy(F.greatest(F.octet_length("text"), F.lit(settings.short_bytes)), "h", "id", "text")
    return (
        rows.join(F.broadcast(counts), "lang").filter(early)  # one row a language
        .withColumns({"rank": F.row_number().over(order), "bytes": F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
        .filter((F.col("rank") <= settings.sample_docs) & (F.col("bytes") <= settings.sample_bytes))
        .select("lang", "rank", "text")
    )


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary per language from at most sample_docs whole texts each; rows with null text or language teach nothing."""
    rows = sorted(tuple(r) for r in sample(docs, settings, id_col, text_col, lang_col).collect())
    return {lang: "\n".join(t for x, _, t in rows if x == lang).lower().encode("utf-8") for lang in sorted({r[0] for r in rows})}


def _predict(dictionaries: dict[str, bytes], s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=s.level)
            coders.append((lang, zstandard.ZstdCompressor(level=s.level, dict_data=d, write_content_size=False, write_dict_id=False).compress))
        for batch in batches:
            langs, scores, sure = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                if not coders or not text or not _LETTER.search(text):
                    langs.append("und"), scores.append(0.0), sure.append(False)
                    continue
                data = text.lower().encode("utf-8")
                parts = [data[at : at + s.chunk] for at in range(0, len(data), s.chunk)]
                sizes = sorted((sum(len(code(p)) for p in parts), lang) for lang, code in coders)
                margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                langs.append(sizes[0][1]), scores.append(margin), sure.append(margin >= s.margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure)],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return run


def languages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: held_out, lang_pred, score (how much smaller the best is than the next) and accepted.

    Only text and language of rows that are not held out are learned from. Null texts and texts without a letter are
    `und` with score 0, as is everything if there is nothing to learn from; a decision by less than the margin still
    names the best language but is not accepted. Ties go to the language that sorts first. Texts are read whole. Rows
    are independent in prediction; a null id is not held out. Other columns are ignored.
    """
    ship(docs.sparkSession)
    dictionaries = fit(docs, settings, id_col, text_col, lang_col)
    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), named(text_col).alias("text"))
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"
    return rows.mapInArrow(_predict(dictionaries, settings), schema)
