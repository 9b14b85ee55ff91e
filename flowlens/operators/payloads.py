"""Audits of attempted rows: what the packets or flows that match a labelled row carry, and what that decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import micros
from flowlens.operators.joins import match_flows
from flowlens.operators.labels import payload_decision, payload_hits
from flowlens.operators.pools import payload_facts
from flowlens.operators.ranks import ranked


def signature(label: Column, text: Column) -> Column:
    """Struct of decision and hits: the patterns of the label's family (sql, xss, else login) that the text holds."""
    low = F.lower(F.coalesce(label, F.lit("")))
    families = {"sql": low.contains("sql"), "xss": low.contains("xss")}
    hits = payload_hits("login", text)
    for family, rule in reversed(families.items()):
        hits = F.when(rule, payload_hits(family, text)).otherwise(hits)
    return F.transform(F.array(hits), lambda h: F.struct(payload_decision(h, text).alias("decision"), h.alias("hits")))[0]


def _decided(rows: DataFrame, csv_bytes: str, label: str, text: Column, matched: Column) -> DataFrame:
    """rows with pcap_match_status, signature_decision and signature_hits; matched is null where rows without payload are not looked for."""
    # Names of states and decisions.
    none = F.array().cast("array<string>")
    empty = F.coalesce(F.col(csv_bytes).cast("double"), F.lit(0.0)) == 0
    found = signature(F.col(label), text)
    decided = rows.withColumn("_found", F.when(~empty & matched, found))
    return decided.withColumns({
        "pcap_match_status": F.when(matched.isNull(), "not_scanned_zero_csv_forward_payload").when(matched, "matched").otherwise("not_matched"),
        "signature_decision": F.when(empty, "keep_excluded").otherwise(F.coalesce("_found.decision", F.lit("manual_review"))),
        "signature_hits": F.coalesce("_found.hits", none),
    }).drop("_found")


def capped_payloads(pairs: DataFrame, row: str, order: list[str], size: str, cap: int = 65_536) -> DataFrame:
    """The pairs whose payloads count: in order, as long as those before are less than cap bytes together; empty ones never do.

    A payload that counts has one byte at least, so no more than cap of them can; ranks come from ranges, so a row with a
    million packets in its window is no single task, and the running total is over the first cap pairs of a row only.
    """
    first = ranked(pairs.filter(F.col(size) > 0), [row], order, "_rank").filter(F.col("_rank") <= cap).drop("_rank")
    before = Window.partitionBy(row).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_before") < cap).drop("_before")


#: How much time one window of running totals covers, and times before and after all others (microseconds).
BAND_US, BEGIN, END = 3_600_000_000, -(1 << 62), 1 << 62


def attempted_packets(
    rows: DataFrame, packets: DataFrame, row: str, tuple_cols: list[str], swaps: list[tuple[str, str]], ts: str, duration: str, csv_bytes: str, label: str, at: str, packet: str, payload: str,
    tolerance: float, cap: int = 65_536,
) -> DataFrame:
    """rows with n_packets, payload_bytes, pcap_match_status, signature_decision and signature_hits.

    A packet belongs to a row if it has its tuple in either direction and its time lies from ts - tolerance to ts + duration
    (seconds, null as 0) + tolerance, ends included; a row without a time takes packets of any time. Rows whose csv_bytes
    are 0 are not looked for. Payloads are taken in the order of time and packet up to cap bytes (as capped_payloads does)
    and joined by line feeds as latin-1 text. Ids of rows and packets must be unique. A packet in the windows of several
    rows counts for each. Rows are not paired with the packets of their windows: running totals of packets and bytes at both
    ends of a window say how many it has and at which byte of its tuple's stream its payloads begin and end. Payloads lie
    in blocks of cap bytes of that stream with those of the next block, so a row meets one block, of bounded size.
    """
    swap = {a: b for a, b in swaps} | {b: a for a, b in swaps}

    def keyed(df: DataFrame) -> DataFrame:  # one key for both directions; null ends match nothing
        plain, turned = (F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]) for cols in (tuple_cols, [swap.get(c, c) for c in tuple_cols]))
        there = F.lit(True)
        for c in tuple_cols:
            there = there & F.col(c).isNotNull()
        return df.withColumn("_key", F.when(there, F.least(plain, turned)))

    empty = F.coalesce(F.col(csv_bytes).cast("double"), F.lit(0.0))
    us, slack = micros(ts), round(tolerance * 1e6)
    high = F.floor(F.greatest(F.least(us + F.coalesce(F.col(duration).cast("double"), F.lit(0.0)) * 1e6 + slack, F.lit(4e18)), F.lit(-4e18)))
    low = F.coalesce(us - slack, F.lit(BEGIN))
    windows = keyed(rows.filter(empty > 0)).select("_key", F.col(row).alias("_row"), low.alias("_low"), F.when(us.isNull(), F.lit(END)).otherwise(high).alias("_high")).filter("_key is not null and _low <= _high")
    # In order of time and turn a window's first end stands before the packets of its time, its last end after them.
    ends = windows.select("_key", "_row", F.inline(F.array(F.struct(F.col("_low").alias("_t"), F.lit(0).alias("_turn")), F.struct(F.col("_high").alias("_t"), F.lit(2).alias("_turn")))))
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint")
    seen = keyed(packets).filter("_key is not null").select("_key", F.coalesce(micros(at), F.lit(BEGIN)).alias("_t"), F.lit(1).alias("_turn"), F.col(packet).alias("_packet"), size.alias("_size"), F.col(payload).alias("_payload"))
    stream = seen.unionByName(ends, allowMissingColumns=True).withColumn("_band", F.floor(F.col("_t") / BAND_US))
    bands = stream.groupBy("_key", "_band").agg(F.count("_size").alias("_n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("_key", "_band", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")])
    upto = Window.partitionBy("_key", "_band").orderBy("_t", "_turn", "_packet").rowsBetween(Window.unboundedPreceding, 0)
    stream = stream.withColumns({"_n": F.count("_size").over(upto), "_sum": F.coalesce(F.sum("_size").over(upto), F.lit(0))}).join(bands, ["_key", "_band"])
    stream = stream.withColumns({"_n": F.col("_n") + F.col("_n_before"), "_sum": F.col("_sum") + F.col("_sum_before")})

    def end(turn: int, c: str) -> Column:
        return F.max(F.when(F.col("_turn") == turn, F.col(c)))

    facts = stream.filter("_row is not null").groupBy("_row").agg((end(2, "_n") - end(0, "_n")).alias("n_packets"), end(0, "_sum").alias("_from"), end(2, "_sum").alias("_to"))
    held = stream.filter("_size > 0").withColumn("_at", F.col("_sum") - F.col("_size"))
    own = F.floor(F.col("_at") / cap)
    text = F.struct(F.col("_at").alias("at"), F.col("_size").alias("size"), F.decode("_payload", "ISO-8859-1").alias("text"))
    blocks = held.select("_key", F.explode(F.array(own - 1, own)).alias("_block"), text.alias("_item")).groupBy("_key", "_block").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    out = keyed(rows).join(facts, F.col(row) == F.col("_row"), "left").drop("_row").withColumn("_block", F.when(F.col("_from") < F.col("_to"), F.floor(F.col("_from") / cap)))
    out = out.join(blocks, ["_key", "_block"], "left")
    to = F.least(F.col("_to"), F.col("_from") + cap)
    out = out.withColumn("_items", F.filter("_items", lambda x: (x["at"] >= F.col("_from")) & (x["at"] < to)))
    out = out.withColumns({
        "n_packets": F.coalesce("n_packets", F.lit(0).cast("bigint")),
        "payload_bytes": F.coalesce(F.aggregate("_items", F.lit(0).cast("bigint"), lambda s, x: s + x["size"]), F.lit(0).cast("bigint")),
        "_text": F.concat_ws("\n", "_items.text"),
    }).select(*rows.columns, "n_packets", "payload_bytes", "_text")
    zero = empty == 0
    return _decided(out, csv_bytes, label, F.col("_text"), F.when(~zero, F.col("n_packets") > 0)).drop("_text")


def attempted_flows(
    rows: DataFrame, flows: DataFrame, row: str, tuple_cols: list[str], swaps: list[tuple[str, str]], ts: str, csv_bytes: str, label: str, flow_ts: str, flow_order: str, payloads: str, tolerance: float
) -> DataFrame:
    """rows with the first flow in emission order that matches them, and what its captured packets carry.

    flow_order (unique) says which flow comes first; a flow matches a row of its tuple in either direction whose time is no
    further than tolerance, or that has none. payloads is the flow's array of binaries, null ones without a payload. Adds
    matched_flow, delta_us, n_packets, payload_bytes, payload_nonzero, pcap_match_status, signature_decision and
    signature_hits; rows whose csv_bytes are 0 are matched too, but stay excluded.
    """
    matched = match_flows(rows.select(row, *tuple_cols, ts), flows.select(*tuple_cols, flow_ts, flow_order), tuple_cols, swaps, row, ts, flow_ts, flow_order, tolerance, strict=False)
    facts = F.filter(F.coalesce(F.col(payloads), F.array().cast("array<binary>")), lambda b: b.isNotNull())
    carried = flows.select(
        F.col(flow_order).alias("matched_flow"), F.size(facts).cast("bigint").alias("n_packets"),
        F.aggregate(facts, F.lit(0).cast("bigint"), lambda s, b: s + F.octet_length(b)).alias("payload_bytes"), payload_facts(F.col(payloads))["nonzero"].alias("payload_nonzero"),
        F.array_join(F.transform(F.filter(facts, lambda b: F.octet_length(b) > 0), lambda b: F.decode(b, "ISO-8859-1")), "\n").alias("_text"),
    )
    best = matched.select(F.col(row).alias("_row"), F.col(flow_order).alias("matched_flow"), "delta_us").join(carried, "matched_flow")
    out = rows.join(best, F.col(row) == F.col("_row"), "left").drop("_row")
    numbers = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in (("n_packets", "bigint"), ("payload_bytes", "bigint"), ("payload_nonzero", "double"))}
    return _decided(out.withColumns(numbers), csv_bytes, label, F.col("_text"), F.col("matched_flow").isNotNull()).drop("_text")
