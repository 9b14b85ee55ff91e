"""Label normalisation and row decisions (predicates and decision lists)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions import vocabulary as V
from flowlens.functions.scalars import compact, squeezed


def _lookup(value: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, values in groups.items():
        out = F.when(value.isin(*values), name).otherwise(out)
    return out


def iot_class(label: Column) -> Column:
    """Exact subtype, then prefixes of the label without blanks, dashes and underscores, then web names; else null."""
    c = F.translate(F.lower(F.trim(label)), " -_", "")
    by_name = F.when(c.isin("benign", "benigntraffic", "benignfinal"), "Benign")
    for prefix, name in (("ddos", "DDoS"), ("dos", "DoS"), ("mirai", "Mirai"), ("recon", "Recon")):
        by_name = by_name.when(c.startswith(prefix), name)
    by_name = (
        by_name.when(c == "vulnerabilityscan", "Recon")
        .when(c.isin("dnsspoofing", "mitmarpspoofing"), "Spoofing")
        .when(c == "dictionarybruteforce", "BruteForce")
        .when(c.isin(*V.WEB_NAMES), "WebBased")
    )
    return F.coalesce(_lookup(F.trim(label), V.IOT_SUBTYPES), by_name)


def office_class(label: Column) -> Column:
    """Aliases of the compacted label, then prefixes and parts of it; else null."""
    c = compact(label)
    by_part = (
        F.when(c.startswith("webattack"), "WebBased")
        .when(c.startswith("ddos"), "DDoS")
        .when(c.startswith("dos"), "DoS")
        .when(c.contains("bruteforce"), "BruteForce")
        .when(c.startswith("infiltration"), "Infiltration")
    )
    return F.coalesce(_lookup(c, V.OFFICE_LABELS), by_part)


def is_attempt(label: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.lit(False)
    for mark in V.ATTEMPT_MARKS:
        out = out | text.contains(mark)
    return out


def label_status(label: Column, rules: list[tuple[Column, str]], klass: Column | None = None) -> Column:
    """unknown_label, excluded attempts, the first documented contamination rule that holds, else accepted_label."""
    klass = office_class(label) if klass is None else klass
    out = F.when(klass.isNull(), "unknown_label").when(is_attempt(squeezed(label)), "excluded_attempted_or_non_success")
    for rule, name in rules:
        out = out.when(rule, name)
    return out.otherwise("accepted_label")


def crosscheck(csv_class: Column, status: Column, window_class: Column) -> Column:
    """How a row's own label and the attack window it falls into agree."""
    matched = window_class.isNotNull()
    return (
        F.when(csv_class.isNull(), "unknown_csv_label")
        .when((status != "accepted_label") & matched, "excluded_csv_label_with_gt_match")
        .when(status != "accepted_label", "excluded_csv_label_without_gt_match")
        .when(~matched & (csv_class == "Benign"), "agreement_benign")
        .when(~matched, "csv_attack_no_gt_match")
        .when(csv_class == "Benign", "csv_benign_gt_attack_match")
        .when(csv_class == window_class, "agreement_attack")
        .otherwise("csv_gt_class_mismatch")
    )


def payload_hits(family: str, text: Column) -> Column:
    """Names of the family's patterns that the text holds, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(p)), n) for n, p in V.PAYLOAD_PATTERNS[family].items()]))


def payload_decision(hits: Column, text: Column) -> Column:
    return F.when(F.size(hits) > 0, "recover").when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, "manual_review").otherwise("keep_excluded")


def endpoint_choice(src_files: Column, dst_files: Column, src_private: Column, dst_private: Column) -> Column:
    """Which endpoint's capture files serve a row: the only one that has any, else the private one, else the destination's."""
    src, dst = F.coalesce(src_files, F.lit(0)), F.coalesce(dst_files, F.lit(0))

    def parts(n, name):
        return F.when(n > 1, f"{name}_multi_part").otherwise(name)

    return (
        F.when((src == 0) & (dst == 0), "none")
        .when(dst == 0, parts(src, "src_only"))
        .when(src == 0, parts(dst, "dst_only"))
        .when(src_private & ~dst_private, parts(src, "private_src"))
        .otherwise(parts(dst, "dst_preferred"))
    )


def mac_decision(src: Column, dst: Column, attackers: Column, is_benign: Column) -> Column:
    """Keep or drop a flow by the attackers' hardware addresses, with the reason."""
    known = F.array_contains(attackers, src) | F.array_contains(attackers, dst)
    return (
        F.when(F.size(attackers) == 0, "kept_filter_disabled")
        .when(src.isNull() & dst.isNull(), "kept_missing_mac")
        .when(is_benign & known, "dropped_benign_attacker")
        .when(is_benign, "kept_benign")
        .when(known, "kept_attack")
        .otherwise("dropped_attack_background")
    )
