"""Fill-in-the-middle texts: documents cut at unit boundaries and put together in another order around three marks.

A unit grammar says what the pieces of a text are: its classes of characters, and which neighbours stay together. It is
translated to one regular expression of zero width, an alternation of ``(?<=[left])(?=[right])`` over the pairs of
neighbouring classes between which a text is cut. Spark's split at that expression keeps every character, so the pieces
joined again are the text. An empty text has no piece; split would give one, so it is handled apart.

All work is DataFrame expressions over one row: no shuffle, and whole texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import let, named, need, spare

_WHITE = r"\x20\x09-\x0D"

#: Grammars by name: classes of characters as the inside of a bracket expression, and the pairs (left, right) of
#: neighbouring classes between which a unit ends. Classes must not overlap where both are on one side of a pair.
GRAMMARS: dict[str, tuple[Mapping[str, str], Sequence[tuple[str, str]]]] = {
    # [white]*[other]+|[white]+ : white space goes with the word after it
    "words": ({"white": _WHITE, "other": f"^{_WHITE}"}, [("other", "white")]),
    # [other]+[white]*|[white]+ : white space goes with the word before it
    "words_then_space": ({"white": _WHITE, "other": f"^{_WHITE}"}, [("white", "other")]),
    # [^\n]*\n|[^\n]+ : lines with their ends
    "lines": ({"end": r"\n", "any": r"\x{0}-\x{10FFFF}"}, [("end", "any")]),
    # one code point each
    "characters": ({"any": r"\x{0}-\x{10FFFF}"}, [("any", "any")]),
    # runs of one class: letters and digits, white space, and all else
    "runs": (
        {"word": r"\p{L}\p{M}\p{N}_", "white": _WHITE, "rest": rf"^\p{{L}}\p{{M}}\p{{N}}_{_WHITE}"},
        [("word", "white"), ("word", "rest"), ("white", "word"), ("white", "rest"), ("rest", "word"), ("rest", "white")],
    ),
}

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"


def boundary(grammar: str) -> str:
    """The regular expression of zero width at which units of that grammar end."""
    if grammar not in GRAMMARS:
        raise ValueError(f"there is no grammar {grammar!r}; there are {sorted(GRAMMARS)}")
    classes, cuts = GRAMMARS[grammar]
    return "|".join(f"(?<=[{classes[a]}])(?=[{classes[b]}])" for a, b in cuts)


def units(text: Column, grammar: str = "words") -> Column:
    """The units of a text in order; none for an empty or null one."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, boundary(grammar), -1))


def draws(seed: int, key: Column, n: int = 4) -> list[Column]:
    """The first n groups of eight hexadecimal digits of sha256('seed:key') as unsigned integers; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from its output and form alone.

    Texts that hold a mark are plain, and a mark begins with its only < and ends with its only >, so that the marks found
    in an output of another form are those that were put there.
    """
    parts = F.split(output, _MARK, -1)  # the first one is empty: the output begins with a mark
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: str = "words", seed: int = 42, percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """docs with columns n, form, prefix_chars, middle_chars and output (in place of columns of these names).

    A text is cut into n units. Four numbers h1 to h4 come from the hash of seed and id: the prefix ends after the smaller
    of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger, the suffix is the rest. percent of the texts are
    changed (h3), spm_percent of those in the order suffix, prefix, middle (h4), the others as prefix, suffix, middle.
    Empty texts and texts that hold a mark stay plain.

    Null texts count as empty; a null id is the empty string to the hash. Rows that repeat an id draw the same numbers,
    each for its own text. Texts are cut whole, at any length; an empty table gives no rows. Helper columns take names
    that docs has not got.
    """
    need(docs, [id_col, text_col])
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    base = docs.drop(*[c for c in docs.columns if c.lower() in made and c not in (id_col, text_col)])
    clash = [c for c in (id_col, text_col) if c.lower() in made]
    if clash:
        raise ValueError(f"columns {clash} have the names of results")
    [done] = spare(base, "done")
    draw = F.struct(*[d.alias(f"h{k + 1}") for k, d in enumerate(draws(seed, named(id_col)))])

    def parts(x: Column) -> Column:
        """The three parts and the form, from a struct of the whole text, its pieces and the draws."""
        n = F.size(x["pieces"]).cast("bigint")
        at = let(
            F.array(x["draw"]["h1"] % (n + 1), x["draw"]["h2"] % (n + 1)),
            lambda ends: F.struct(F.array_min(ends).cast("int").alias("low"), F.array_max(ends).cast("int").alias("high")),
        )
        plain = (x["whole"] == "") | x["whole"].rlike(_MARK) | (x["draw"]["h3"] % 100 >= percent)
        form = F.when(plain, "plain").when(x["draw"]["h4"] % 100 < spm_percent, "spm").otherwise("psm")
        piece = lambda first, length: F.array_join(F.slice(x["pieces"], first, length), "")
        cut = lambda e: F.struct(
            x["whole"].alias("whole"), n.alias("n"), form.alias("form"), piece(F.lit(1), e["low"]).alias("head"),
            piece(e["low"] + 1, e["high"] - e["low"]).alias("middle"), piece(e["high"] + 1, n.cast("int") - e["high"]).alias("tail"),
        )
        return let(let(at, cut), output)

    def output(x: Column) -> Column:
        p, s, m = (F.concat(F.lit(mark), x[part]) for mark, part in ((PREFIX, "head"), (SUFFIX, "tail"), (MIDDLE, "middle")))
        chars = lambda part: F.when(x["form"] != "plain", F.length(x[part]).cast("bigint"))
        return F.struct(
            x["n"].alias("n"), x["form"].alias("form"), chars("head").alias("prefix_chars"), chars("middle").alias("middle_chars"),
            F.when(x["form"] == "psm", F.concat(p, s, m)).when(x["form"] == "spm", F.concat(s, p, m)).otherwise(x["whole"]).alias("output"),
        )

    text = F.coalesce(named(text_col), F.lit(""))
    step = base.withColumn(done, let(F.struct(text.alias("whole"), units(text, grammar).alias("pieces"), draw.alias("draw")), parts))
    return step.select(*[named(c) for c in base.columns], *[named(done)[c].alias(c) for c in made])
