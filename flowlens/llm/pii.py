"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import let, named, need, spare

# Fixed patterns of the four base kinds. Possessive quantifiers and the look-behinds only stop retries that cannot
# match, so that long runs take linear time; matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Country, check digits, and as many characters as the country's numbers have, by fours, blanks between them or not."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


# Kinds that the method adds.
IBAN = _iban()
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"


@dataclass(frozen=True)
class Kind:
    """Order of listing, a string that each match holds, the pattern, a start score and words that raise it."""

    name: str
    hint: str
    pattern: str
    score: float
    words: str
    base: bool


KINDS = (
    Kind("email", "@", EMAIL, 0.9, r"e-?mail|mail|contact|write to|courriel|correo", True),
    Kind("ip", ".", IP, 0.7, r"\bip\b|address|host|server|adresse", True),
    Kind("card", "", CARD, 0.6, r"card|visa|master ?card|amex|credit|debit|carte|karte|tarjeta", True),
    Kind("phone", "+", PHONE, 0.7, r"phone|tel|call|fax|mobile|cell|whatsapp|telefon|t[ée]l[ée]fono", True),
    Kind("iban", "", IBAN, 0.8, r"iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", "-", SSN, 0.3, r"\bssn\b|social security|tax id", False),
    Kind("local_phone", "", LOCAL_PHONE, 0.3, r"phone|\btel\b|call|fax|mobile|\bcell\b|telefon", False),
)
ACCEPT, BONUS, NEAR = 0.5, 0.3, 48


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN without spaces: the first four characters go last, letters count as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4))

    def step(rest, c):
        v = F.ascii(c)
        return F.when(v < 58, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, part))
    if kind == "card":
        return let(digits, lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda m: F.length(m).between(15, 34) & (mod97(m) == 1))
    if kind == "ssn":
        return ~F.regexp_like(match, F.lit(r"^(000|666|9[0-9]{2})|-00-|-0000$"))
    return F.lit(True)


def before(lengths: Column, block: int = 128) -> Column:
    """For each element the sum of those before it; blocks keep the work of long arrays near linear."""

    def total(a):
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def body(a):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return let(
            starts,
            lambda s: F.transform(
                a,
                lambda x, i: s[F.floor(i / block).cast("int")]
                + total(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block)),
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, body)).otherwise(F.array().cast("array<int>"))


_CHUNK = 4096


def _chunks(text: Column) -> Column:
    """The text in pieces of _CHUNK code points: a place in it is found without counting through all that is before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), 0)


def _cut_out(chunks: Column, start: Column, length: Column) -> Column:
    """length code points from start (from 0) of a text in chunks."""
    first, last = F.floor(start / _CHUNK).cast("int"), F.floor((start + length) / _CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * _CHUNK + 1, length)


def _spans(kind: Kind, order: int, text: Column, has_digit: Column) -> Column:
    """Confirmed spans of one kind as structs (start, kind order, end, score); code points, end exclusive."""

    def placed(found):
        gaps = F.split(text, kind.pattern, -1)

        def body(parts):
            offsets = before(F.transform(parts, lambda p: p["gap"] + F.length(p["m"])))
            return F.zip_with(parts, offsets, lambda p, o: F.struct((o + p["gap"]).alias("at"), p["m"].alias("m")))

        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
        return let(pairs, body)

    def scored(chunks):
        def one(s):
            start = F.greatest(s["at"] - NEAR, F.lit(0))
            around = F.lower(_cut_out(chunks, start, F.length(s["m"]) + 2 * NEAR))
            bonus = F.when(F.regexp_like(around, F.lit(kind.words)), BONUS).otherwise(0.0)
            return F.struct(
                s["at"].alias("start"),
                F.lit(order).alias("kind"),
                (s["at"] + F.length(s["m"])).alias("end"),
                F.least(F.lit(kind.score) + bonus, F.lit(1.0)).alias("score"),
            )

        return one

    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    spans = let(
        found,
        lambda f: F.when(
            F.size(f) > 0,
            let(_chunks(text), lambda c: F.transform(F.filter(placed(f), lambda s: confirmed(kind.name, s["m"])), scored(c))),
        ).otherwise(none),
    )
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= ACCEPT)
    may = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    return F.when(may if kind.name == "email" else may & has_digit, spans).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", spans_as: str = "pii_spans") -> DataFrame:
    """docs with a further column spans_as, an array of (start, kind, end, score) in text order, over whole texts.

    kind is the place in KINDS. Spans of the base kinds all stay; those of added kinds need the score ACCEPT. Null text
    counts as empty and has no spans. Each row is looked at alone, so repeated rows and ids do no harm; an empty table
    stays empty. Of the columns of docs only text_col is read, whatever the names of the others; only a column named
    spans_as would be replaced.
    """
    need(docs, [text_col])
    text, digit, *parts = spare(docs, "pii_text", "has_digit", *[f"pii_{k.name}" for k in KINDS])
    rows = docs.withColumn(text, F.coalesce(named(text_col), F.lit("")))
    rows = rows.withColumn(digit, F.regexp_like(named(text), F.lit("[0-9]")))
    for k, (kind, part) in enumerate(zip(KINDS, parts, strict=True)):
        rows = rows.withColumn(part, _spans(kind, k, named(text), named(digit)))
    every = F.array_sort(F.concat(*[named(p) for p in parts]))
    return rows.withColumn(spans_as, every).drop(text, digit, *parts)


def written(spans: Column, with_score: bool = False) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])

    def one(s):
        parts = [names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")]
        return F.concat(*parts, *([F.lit(":"), F.round(s["score"], 2).cast("string")] if with_score else []))

    return F.array_join(F.transform(spans, one), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts and digest of the base spans, all spans, and all spans with scores.

    Null text counts as empty: no spans, and the digest of an empty list. Texts are searched whole, at any length. Rows are
    independent, so repeated rows and ids repeat their results; other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    need(docs, [id_col, text_col])
    found = find_pii(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")))
    base = [k for k, kind in enumerate(KINDS) if kind.base]

    def of_kind(k):
        return lambda s: s["kind"] == k

    return found.select(
        "doc_id",
        *[
            F.size(F.filter("pii_spans", of_kind(k))).cast("bigint").alias(f"n_{KINDS[k].name}") for k in base
        ],
        F.sha2(written(F.filter("pii_spans", lambda s: s["kind"] < len(base))), 256).alias("base_sha256"),
        written(F.col("pii_spans")).alias("spans"),
        written(F.col("pii_spans"), True).alias("scored_spans"),
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in text_col replaced by its kind in brackets; overlapping spans become one.

    Null text stays null; text without spans is not touched. Texts are taken whole, rows alone, and other columns pass
    through, whatever their names; an empty table stays empty.
    """
    columns = [named(c) for c in docs.columns]
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    [spans_as] = spare(docs, "pii_spans")

    def body(chunks, spans):
        def step(acc, s):
            new = s["start"] >= acc["at"]
            piece = F.when(new, F.concat(_cut_out(chunks, acc["at"], s["start"] - acc["at"]), names[s["kind"]])).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))

        def block(acc, b):
            # Parts of a block are joined before they are added to the others: long lists are not copied span by span.
            start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("parts"))
            inner = F.aggregate(F.slice(spans, b * 256 + 1, F.lit(256)), start, step)
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["parts"], F.array(F.array_join(i["parts"], ""))).alias("parts")))

        def finish(acc):
            last = F.floor(acc["at"] / _CHUNK).cast("int")
            rest = F.array_join(F.slice(chunks, last + 1, F.greatest(F.size(chunks) - last, F.lit(0))), "")
            return F.concat(F.array_join(acc["parts"], ""), F.substring(rest, acc["at"] - last * _CHUNK + 1, F.length(rest)))

        blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / 256).cast("int"))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(blocks, nothing, block, finish)

    found = find_pii(docs, text_col, spans_as)
    text, spans = named(text_col), named(spans_as)
    clean = F.when(F.size(spans) > 0, let(_chunks(text), lambda c: body(c, spans))).otherwise(text)
    return found.withColumn(text_col, clean).select(*columns)
