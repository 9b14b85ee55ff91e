"""Labelled flows against documented attack windows: matching, label rules, and which packets a window needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import vocabulary as V
from flowlens.functions.scalars import is_ip, parsed_time, squeezed
from flowlens.operators.joins import first_window
from flowlens.operators.labels import is_attempt, office_class

WINDOW = "ordinal int, subtype string, klass string, start string, finish string"


def attack_window(day: Column, src: Column, dst: Column, ts: Column, windows: Sequence[tuple] = V.ATTACK_WINDOWS, port: Column | None = None) -> Column:
    """The first window of the day that a row is in, as a struct of WINDOW; null fields if it is in none.

    A row is in a window if its time is (ends included) and its endpoints are an attacker and a victim, in either
    direction; for infiltration a victim at either end is enough. With a port, only rows to port 80 match.
    """
    found = []
    for k, (name, subtype, klass, attackers, victims, start, finish) in enumerate(windows):
        there = src.isin(*victims) | dst.isin(*victims)
        if subtype != "Infiltration":
            there = (src.isin(*attackers) & dst.isin(*victims)) | (dst.isin(*attackers) & src.isin(*victims))
        inside = (day == name) & ts.between(F.lit(start).cast("timestamp"), F.lit(finish).cast("timestamp")) & there
        found.append(((k, subtype, klass, start, finish), inside if port is None else inside & (port == "80")))
    return first_window(found, WINDOW)


def label_status(day: Column, label: Column, src: Column, dst: Column, port: Column, sent: Column) -> Column:
    """What a row's own label is worth: unknown, an attempt, documented contamination of the brute-force day, or accepted.

    port and sent (total length of what the source sent) are text, as in the files.
    """
    klass = office_class(label)
    # Addresses of the documented contamination.
    day_rows = (day == "Wednesday-14-02-2018") & (klass == "BruteForce") & (dst == "172.31.69.25")
    ssh = day_rows & (src == "13.58.98.64")
    return (
        F.when(klass.isNull(), "unknown_label")
        .when(is_attempt(squeezed(label)), "excluded_attempted_or_non_success")
        .when(day_rows & (src == "18.221.219.4"), "excluded_documented_ftp_closed_port")
        .when(ssh & sent.isin("0", "0.0"), "excluded_documented_ssh_no_attacker_payload")
        .when(ssh & (port == "21"), "excluded_documented_ssh_wrong_service_port")
        .otherwise("accepted_label")
    )


def crosschecked(rows: DataFrame, day: str, src: str, dst: str, ts: str, label: str, port: str, sent: str) -> DataFrame:
    """rows of a labelled CSV (all text) with csv_class, label_status and window: everything in one pass, without a shuffle."""
    d, a, b = F.col(day), F.coalesce(src, F.lit("")), F.coalesce(dst, F.lit(""))
    return rows.withColumns(
        {
            "csv_class": office_class(F.col(label)),
            "label_status": label_status(d, F.col(label), a, b, F.col(port), F.col(sent)),
            "window": attack_window(d, a, b, parsed_time(F.col(ts))),
        }
    )


def source_tag(day: Column) -> Column:
    """The name of a day's part of the data set, by its weekday."""
    return F.concat(F.lit("CIC-IDS2018-"), F.split(day, "-")[0])


def needs_preslice(klass: Column) -> Column:
    return F.coalesce(klass, F.lit("")).isin(*V.PRESLICE_CLASSES)


def window_table(df: DataFrame, windows: Sequence[tuple] = V.ATTACK_WINDOWS) -> DataFrame:
    """The windows as a table of a few rows: ordinal, day, subtype, class_name, attackers, victims, start, finish."""
    rows = [(k, *w[:3], list(w[3]), list(w[4]), *w[5:]) for k, w in enumerate(windows)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, day string, subtype string, class_name string, attackers array<string>, victims array<string>, start string, finish string"
    )


def preslice_pairs(candidates: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture, attacker, victim): the endpoints to keep of each capture for candidates(day, class_name); captures(capture, ip).

    A capture of a victim needs that victim's pairs, one of an attacker the attacker's, another one all of its windows.
    Candidates only say which few (day, class) there are.
    """
    wanted = candidates.filter(needs_preslice(F.col("class_name"))).select("day", "class_name").distinct()
    windows = F.broadcast(window_table(candidates)).join(wanted, ["day", "class_name"], "left_semi")
    each = captures.crossJoin(F.broadcast(windows))  # a few windows
    is_victim, is_attacker = F.coalesce(F.array_contains("victims", F.col("ip")), F.lit(False)), F.coalesce(F.array_contains("attackers", F.col("ip")), F.lit(False))
    own = F.array("ip")
    return (
        each.select("capture", F.when(~is_victim & is_attacker, own).otherwise(F.col("attackers")).alias("a"), F.when(is_victim, own).otherwise(F.col("victims")).alias("v"))
        .withColumn("attacker", F.explode("a")).select("capture", "attacker", F.explode("v").alias("victim")).distinct()
    )


def pair_filters(pairs: DataFrame) -> DataFrame:
    """(capture, filter): the pairs of each capture as one capture-filter text, in order."""
    clause = F.concat(F.lit("(host "), "attacker", F.lit(" and host "), "victim", F.lit(")"))
    ok = is_ip(F.col("attacker")) & is_ip(F.col("victim"))
    return pairs.filter(ok).groupBy("capture").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("attacker", "victim", clause.alias("text")))), lambda p: p["text"]), " or ").alias("filter"))


def tuple_filter(src: Column, dst: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """The capture-filter clause of one flow tuple; null if an address is none."""
    p = F.lower(F.trim(F.coalesce(protocol, F.lit(""))))
    name = F.when(p.isin("6", "tcp"), "tcp").when(p.isin("17", "udp"), "udp").when(F.regexp_like(p, F.lit("^[0-9]+$")), F.concat(F.lit("ip proto "), p.try_cast("bigint").cast("string"))).otherwise("ip")
    a, b = src_port.try_cast("int"), dst_port.try_cast("int")
    ports = F.when(name.isin("tcp", "udp") & a.between(0, 65535) & b.between(0, 65535), F.concat(F.lit(" and src port "), a.cast("string"), F.lit(" and dst port "), b.cast("string")))
    text = F.concat(F.lit("("), name, F.lit(" and src host "), src, F.lit(" and dst host "), dst, F.coalesce(ports, F.lit("")), F.lit(")"))
    return F.when(is_ip(src) & is_ip(dst), text)


def candidate_filters(candidates: DataFrame, capture: str, tuple_cols: Sequence[str]) -> DataFrame:
    """(capture, filter, tuples): one capture-filter text for each capture's candidates, and how many tuples they have.

    Candidates count in both directions and each tuple (source and destination address, their ports, protocol) once; tuples
    without two addresses are counted but have no clause. Clauses stand in the order of their text. The text is the
    result, so a capture's clauses meet in one row; repeats go before.
    """
    src, dst, src_port, dst_port, protocol = tuple_cols
    swap = {src: dst, dst: src, src_port: dst_port, dst_port: src_port}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    forward = candidates.select(capture, *[text(c) for c in tuple_cols])
    both = forward.unionByName(forward.select(capture, *[F.col(swap.get(c, c)).alias(c) for c in tuple_cols])).distinct()
    clause = tuple_filter(*[F.col(c) for c in (src, dst, src_port, dst_port, protocol)])
    return both.groupBy(capture).agg(F.array_join(F.array_sort(F.collect_list(clause)), " or ").alias("filter"), F.count(F.lit(1)).alias("tuples"))


def infiltration_decision(in_window: Column, endpoints: Column, host: str, own_capture: Column, protocol: Column, payload: Column, ip_sizes: Column, transport_sizes: Column, payload_sizes: Column) -> Column:
    """Whether a flow of the infiltration day is a scan without payload, carries payload, or must be looked at.

    payload is binary; the three size arrays have one element a packet.
    """
    nonzero = F.length(F.regexp_replace(F.hex(payload), "(00)+$", "")) > 0  # bytes that are not padding
    # Names of the decisions.
    silent = (F.size(payload_sizes) > 0) & F.forall(payload_sizes, lambda x: x == 0)

    def all_within(sizes, low, high):
        return (F.size(sizes) > 0) & F.forall(sizes, lambda x: x.between(low, high))

    scan = (protocol == 6) & silent & ~nonzero & all_within(ip_sizes, 40, 60) & all_within(transport_sizes, 20, 40)
    ours = in_window & F.array_contains(endpoints, host) & own_capture
    return F.coalesce(F.when(ours & scan, "confirmed_zero_payload_scan_probe").when(ours & nonzero, "matched_infiltration_with_payload"), F.lit("manual_review"))


def probe_class(primary_hit: Column, other_hit: Column, primary_delta: Column, other_delta: Column, missing: Column, captures: Column) -> Column:
    """Six ways in which a probe was found among the packets of its captures, or was not."""
    # Names of the ways.
    return (
        F.when(primary_hit, "primary_tuple_within_window")
        .when(other_hit, "alternate_tuple_within_window")
        .when(primary_delta.isNotNull(), "primary_tuple_outside_window")
        .when(other_delta.isNotNull(), "alternate_tuple_outside_window")
        .when((missing > 0) & (missing >= captures), "primary_pcap_missing")
        .otherwise("tuple_not_seen_in_scanned_pcaps")
    )
