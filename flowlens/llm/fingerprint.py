"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text's tokens are its words (pieces of 16 code points of longer ones, so that text without white space has tokens
too). Every run of ``k`` tokens is a k-mer; its n-th occurrence in the text is numbered n, so that repeats count. The
hash of (k-mer, occurrence) says to which of ``slots * 2`` cells it belongs, and each cell keeps its least hash. A slot
takes the k-mers of its two cells, or, where they are empty, of the next cells that are not, around the circle: so every
slot of a text with two k-mers or more holds two of them. They are put back into text order and hashed as a tuple. Two
texts agree in a slot if they share its k-mers *and* their order, so the likeness falls both with replaced and with moved
text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut_with, let, named, need
from flowlens.llm.order import neighbours

SLOTS, K = 64, 3
_NO_ID = -(2**63)  # stands for a null id
_TOKEN = r"[^\x20\x09-\x0D]{1,16}"
_KEYS = ["id", "n", "h"]
_OWN, _OTHER = 1, 2  # which of two texts has a k-mer


def _kmers(tokens: Column, k: int, at: Column, side: Callable[[Column], Column]) -> Column:
    """(w, at, side) of the runs of k tokens: hash, place (the first one's is ``at``) and which texts have it; a text with
    fewer tokens has one run, without tokens none."""

    def body(t):
        firsts = F.slice(t, 1, F.greatest(F.size(t) - (k - 1), F.lit(1)))

        def run(x, i):
            return F.struct(F.xxhash64(x, *[F.get(t, i + j) for j in range(1, k)]).alias("w"), (i + at).alias("at"), side(i).alias("side"))

        return F.transform(firsts, run)

    return let(tokens, body)


def _numbered(repeated: Column, side: int) -> Column:
    """Of (w, at, side, nth) in order of w and place, those that one text has, numbered within their k-mer from 1."""

    def numbers(a):
        first = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: (i == 0) | (i == F.size(a)) | ~a[F.greatest(i - 1, F.lit(0))]["w"].eqNullSafe(F.get(a, i)["w"]))
        lengths = F.zip_with(F.slice(first, 2, F.size(first)), F.slice(first, 1, F.size(first) - 1), lambda stop, start: stop - start)
        return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(1), n)))

    def entry(x, n):
        return F.struct(x["w"].alias("w"), x["at"].alias("at"), F.lit(side).alias("side"), n.alias("nth"))

    def body(a):
        return F.when(F.size(a) > 0, F.zip_with(a, numbers(a), entry)).otherwise(F.slice(a, 1, 0))

    return let(F.filter(repeated, lambda x: x["side"].isin(side, _OWN | _OTHER)), body)


def order_minhash(texts: DataFrame, keys: list[str], text: str = "text", other: str | None = None, k: int = K, slots: int = SLOTS) -> DataFrame:
    """keys plus own, an array of ``slots`` integers for the text, and, with a second text, other likewise.

    texts is partitioned by some of the keys: everything stays in its partition. Of a second text only the k-mers beyond
    what both texts have in common at their start are worked out again. Texts without tokens have no sketch (null), texts
    without any have no row here.
    """
    sides = {"own": _OWN, "other": _OTHER} if other else {"own": _OWN}
    a = F.regexp_extract_all(text, F.lit(_TOKEN), 0)
    rows = texts.select(*keys, a.alias("a"), *([F.regexp_extract_all(other, F.lit(_TOKEN), 0).alias("b")] if other else []))
    if other:
        # How many tokens are the same from the start on.
        equal = F.zip_with(F.slice("a", 1, F.least(F.size("a"), F.size("b"))), F.slice("b", 1, F.least(F.size("a"), F.size("b"))), lambda x, y: x == y)
        same = let(equal, lambda e: F.when(F.array_contains(e, False), F.array_position(e, False).cast("int") - 1).otherwise(F.size(e)))
        rows = rows.select(*keys, "a", "b", same.alias("same"))
        common = F.greatest(F.col("same") - (k - 1), F.lit(0))  # k-mers that both texts begin with
        mine = _kmers(F.col("a"), k, F.lit(0), lambda i: F.when(i < common, _OWN | _OTHER).otherwise(_OWN))
        theirs = _kmers(F.slice("b", common + 1, F.size("b")), k, common, lambda i: F.lit(_OTHER))
        # Where nothing is left of the second text there is no run of it either; a rest shorter than k is one only if it is all.
        beyond = F.when((common == 0) | (F.size("b") - common >= k), theirs).otherwise(F.slice(mine, 1, 0))
        marked = rows.select(*keys, F.concat(mine, beyond).alias("m"))
    else:
        marked = rows.select(*keys, _kmers(F.col("a"), k, F.lit(0), lambda i: F.lit(_OWN)).alias("m"))
    ordered = marked.select(*keys, F.sort_array("m").alias("m"))

    def counted(x, i):  # only k-mers that stand more than once are numbered below; the others are their own first occurrence
        before, after = F.get("m", i - 1)["w"], F.get("m", i + 1)["w"]
        again = F.coalesce((before == x["w"]) | (after == x["w"]), before == x["w"], after == x["w"], F.lit(False))
        return F.struct(x["w"].alias("w"), x["at"].alias("at"), x["side"].alias("side"), F.when(again, 0).otherwise(1).alias("nth"))

    ordered = ordered.select(*keys, F.transform("m", counted).alias("m"))
    ordered = ordered.select(*keys, "m", F.filter("m", lambda x: x["nth"] == 0).alias("again"))
    parts = [F.col("m"), *[_numbered(F.col("again"), side) for side in sides.values()]]
    entries = ordered.select(*keys, F.explode(F.concat(*parts)).alias("e")).select(*keys, "e.*").filter("nth > 0")
    hashed = entries.select(*keys, "at", "side", F.xxhash64("w", "nth").alias("g"))
    hashed = hashed.withColumn("cell", F.pmod("g", F.lit(2 * slots)).cast("int"))

    def least(name, side):
        g = F.when(F.col("side").bitwiseAND(F.lit(side)) > 0, F.col("g"))
        return F.min(g).alias(f"{name}_g"), F.min_by("at", g).alias(f"{name}_at")

    cells = hashed.groupBy(*keys, "cell").agg(*[c for name, side in sides.items() for c in least(name, side)])
    full = cells.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col(f"{n}_g").isNotNull(), F.struct("cell", f"{n}_g", f"{n}_at")))).alias(n) for n in sides]
    )
    return full.select(*keys, *[_slots(F.col(n), n, slots).alias(n) for n in sides])


def _slots(cells: Column, side: str, slots: int) -> Column:
    """One integer a slot from the filled cells in order: the hash of its two k-mers in the order of the text."""

    def body(c):
        def half(i):  # the slot of a filled cell
            return F.shiftright(c[i]["cell"], 1)

        def pair(i):
            one, two = c[i], c[(i + 1) % F.size(c)]
            turned = one[f"{side}_at"] > two[f"{side}_at"]
            first, second = F.when(turned, two).otherwise(one), F.when(turned, one).otherwise(two)
            return F.xxhash64(first[f"{side}_g"], second[f"{side}_g"]).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int")

        def led(i):
            """A filled cell leads all slots that begin after the filled cell before it and not after itself."""
            n = half(i) - F.when(i == 0, F.lit(-1)).otherwise(half(F.greatest(i - 1, F.lit(0))))
            return F.when(n > 0, F.array_repeat(pair(i), n)).otherwise(F.array().cast("array<int>"))

        rest = F.array_repeat(pair(F.lit(0)), F.lit(slots - 1) - half(F.size(c) - 1))  # behind the last one, around the circle
        return F.when(F.size(c) > 0, F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 1), led)), rest))

    return let(cells, body)


def likeness(a: Column, b: Column) -> Column:
    """Share of slots that agree; two texts without tokens are alike, such a text and another are not."""
    agree = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.size(agree) / F.size(a))


def as_text(sketch: Column, slots: int = SLOTS) -> Column:
    """Eight hexadecimal digits a slot, all dots for a text without tokens."""
    digits = F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit("." * 8 * slots))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: the fingerprint of the text, of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many code points (or all) of
    the next document; after the last comes the first, so a single document follows itself. Documents are in order of
    their ids; different texts under one id are documents of their own, in order of length and hash; rows that repeat
    id and text are one document and each get its result. A null id is an id of its own that sorts first.

    Null text counts as empty; texts without tokens have a fingerprint of dots. An empty table gives an empty result.
    Texts are read whole. Other columns are ignored, whatever their names.
    """
    need(docs, [id_col, text_col])
    plain = docs.select(F.coalesce(named(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    plain = plain.withColumns({"n": F.length("text").cast("bigint"), "h": F.xxhash64("text")})
    # Ids and lengths go ahead of the texts: the part that a document lends is cut before it is sent.
    sizes, seen = cut_with(plain.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("times")), "sizes", most=F.max("times"))
    links = neighbours(sizes, _KEYS).select(
        *_KEYS, "times", F.col("after").alias("next"), F.expr("int(n div 4)").alias("need"), F.col("before").alias("prev"), F.expr("int(before.n div 4)").alias("prev_need")
    )
    # Each text is shuffled once; all that follows up to the sketches stays in that partition. Rows that repeat are
    # reduced to one before, so that none of them is gathered.
    once = plain if (seen["most"] or 1) == 1 else plain.dropDuplicates(_KEYS)
    own = once.join(links.hint("merge"), _KEYS)
    heads = own.select(*[F.col(f"prev.{c}").alias(c) for c in _KEYS], F.expr("substring(text, 1, prev_need)").alias("head"))
    both = own.join(heads.hint("merge"), _KEYS).select(
        *_KEYS, "times", "next", "text", F.concat(F.expr("substring(text, 1, int(n) - need)"), "head").alias("edited")
    )
    sketches = order_minhash(both, _KEYS, "text", "edited", k, slots)
    facts = both.select(*_KEYS, "times", "next", F.sha2("edited", 256).alias("edited_sha256"))
    full, _ = cut_with(facts.join(sketches, _KEYS, "left"), "sketches", rows=F.count(F.lit(1)))
    after = full.select(*[F.col(c).alias(f"next_{c}") for c in _KEYS], F.col("own").alias("next_own"))
    met = full.withColumns({f"next_{c}": F.col(f"next.{c}") for c in _KEYS}).join(after, [f"next_{c}" for c in _KEYS])
    result = met.select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own"), slots).alias("fingerprint"),
        as_text(F.col("other"), slots).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("time"),
    )
    return result.drop("time")
