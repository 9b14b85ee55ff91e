"""Pools of candidates: manifests, final splits, folds, weighted draws, group keys, and checks of what is in a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import vocabulary as V
from flowlens.functions.scalars import file_name, piped, stable_hash
from flowlens.operators.ranks import by_hash, ranked
from flowlens.operators.sampling import score


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def enriched(records: DataFrame, candidates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """records with the listed fields of their candidate where it has one; a candidate's null does not hide a record's value."""
    other = candidates.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = records.join(other, key, "left")
    return out.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) if f in records.columns else F.col(f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def capture_name(endpoint: Column, source_file: Column) -> Column:
    return F.coalesce(file_name(filled(endpoint, source_file)), F.lit("missing_pcap"))


def subtype(gt: Column, own: Column, label: Column) -> Column:
    return F.coalesce(filled(gt, own, label), F.lit("no_subtype"))


def window_key(source: Column, day: Column, klass: Column, kind: Column, start: Column, finish: Column, capture: Column) -> Column:
    """What rows of one attack window share; without a window, of one capture."""
    head = [F.coalesce(filled(c), F.lit("unknown")) for c in (source, day, klass)]
    inside = filled(start, finish).isNotNull()
    return F.when(inside, piped(*head, kind, start, finish)).otherwise(piped(*head, kind, capture))


def endpoint_key(source: Column, day: Column, src: Sequence[Column], dst: Sequence[Column], port: Column, protocol: Column) -> Column:
    parts = [source, day, filled(*src), filled(*dst), port, protocol]
    return piped(*[F.coalesce(filled(p), F.lit("unknown")) for p in parts])


def stress_set(klass: Column, kind: Column) -> Column:
    """The stress set that a subtype is kept out of training for; null for all others."""
    out = F.lit(None).cast("string")
    for (k, s), name in V.STRESS_SETS.items():
        out = F.when((klass == k) & (kind == s), name).otherwise(out)
    return out


def identity(source: Column, day: Column, flow_hash: Column) -> Column:
    return piped(source, day, flow_hash)


def work_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits that name a piece of work."""
    return F.substring(stable_hash(*parts), 1, 16)


def candidate_manifest(rows: DataFrame, klass: str, status: str, flow_hash: str, day: str, recovered: DataFrame, targets: dict[str, int], seed: int, per_day: Sequence[str] = ()) -> DataFrame:
    """Rows to keep of each class: those accepted, and excluded ones whose hash was recovered; then as many as its target.

    Classes in per_day share their target equally among days, the first days taking one more until the rest is used up.
    Rows come in the order of a hash, so the choice is uniform and the same on every run; ranks are cut before the shuffle.
    """
    back = recovered.select(F.col(flow_hash)).distinct()
    ok = rows.filter(F.col(status) == "accepted_label").withColumn("recovered_attempted", F.lit(False))
    again = rows.filter(F.col(status) != "accepted_label").join(back, flow_hash, "left_semi").withColumn("recovered_attempted", F.lit(True))
    pool = ok.unionByName(again).filter(F.col(klass).isin(*targets)).withColumn("_score", score(seed, "candidate", flow_hash))
    target = F.lit(0)
    for name, n in targets.items():
        target = F.when(F.col(klass) == name, n).otherwise(target)
    days = pool.filter(F.col(klass).isin(*per_day)).select(klass, day).distinct() if per_day else pool.limit(0).select(klass, day)
    place = Window.partitionBy(klass).orderBy(day)
    quotas = days.withColumns({"_k": F.row_number().over(place), "_n": F.count(F.lit(1)).over(Window.partitionBy(klass))})
    quotas = quotas.select(klass, day, (F.floor(target / F.col("_n")) + (F.col("_k") <= target % F.col("_n")).cast("int")).cast("int").alias("_quota"))
    most = max(targets.values())
    spread, whole = pool.filter(F.col(klass).isin(*per_day)), pool.filter(~F.col(klass).isin(*per_day))

    def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
        return ranked(by_hash(rows, keys, "_score", most)[0], keys, ["_score", flow_hash], "_rank")

    chosen = placed(whole, [klass]).withColumn("_quota", target)
    by_day = placed(spread, [klass, day]).join(F.broadcast(quotas), [klass, day])  # a row a class and day
    return chosen.unionByName(by_day).filter(F.col("_rank") <= F.col("_quota")).drop("_score", "_quota", "_rank")


def short_classes(df: DataFrame, klass: str, required: dict[str, int]) -> DataFrame:
    """(klass, rows, required) of the classes with fewer rows than they must have, those without any too; a split raises on them."""
    want = df.sparkSession.createDataFrame(sorted(required.items()), f"{klass} string, required bigint")
    have = df.groupBy(klass).agg(F.count(F.lit(1)).alias("rows"))
    return want.join(have, klass, "left").select(klass, F.coalesce("rows", F.lit(0)).alias("rows"), "required").filter("rows < required")


def final_splits(candidates: DataFrame, klass: str, flow_hash: str, order: Sequence[str], sizes: dict[str, dict[str, int]], seed: int, train_only: str | None = None, fill: dict[str, int] | None = None) -> DataFrame:
    """candidates with candidate_split, oversampled_train_reference and oversample_copy_index.

    Each class is split first, in hash order, into exactly train, val and test rows of sizes[class]; a class with fewer
    rows is an error. Rows for which train_only is true all train and are not counted. Then only the training rows of
    classes in fill are repeated up to that many, copy i of the filling being row (hash of seed and i) of them.
    """
    out = None
    bound = F.lit(False) if train_only is None else F.coalesce(F.col(train_only), F.lit(False))
    real = candidates.filter(~bound).filter(F.col(klass).isin(*sizes))
    short = short_classes(real, klass, {c: sum(s.values()) for c, s in sizes.items()}).collect()  # at most one row a class
    if short:
        raise ValueError("classes are short of rows: " + ", ".join(f"{r[klass]} has {r['rows']} of {r['required']}" for r in short))

    def upto(*splits):
        value = F.lit(0)
        for c, s in sizes.items():
            value = F.when(F.col(klass) == c, sum(s[x] for x in splits)).otherwise(value)
        return value

    near, _ = by_hash(real.withColumn("_score", score(seed, "final", flow_hash)), [klass], "_score", max(sum(s.values()) for s in sizes.values()))
    placed = ranked(near, [klass], ["_score", *order, flow_hash], "_rank").drop("_score").filter(F.col("_rank") <= upto("train", "val", "test"))
    split = F.when(F.col("_rank") <= upto("train"), "train").when(F.col("_rank") <= upto("train", "val"), "val").otherwise("test")
    out = placed.withColumn("candidate_split", split).drop("_rank")
    if train_only is not None:
        out = out.unionByName(candidates.filter(bound).withColumn("candidate_split", F.lit("train")))
    out = out.withColumns({"oversampled_train_reference": F.lit(False), "oversample_copy_index": F.lit(0)})
    for c, target in (fill or {}).items():
        seeds = out.filter((F.col(klass) == c) & (F.col("candidate_split") == "train"))
        numbered = ranked(seeds, [], [flow_hash], "_n").withColumn("_n", F.col("_n") - 1)
        n = seeds.count()
        if n:
            draws = candidates.sparkSession.range(1, max(target - n, 0) + 1).select(
                F.col("id").cast("int").alias("_copy"), (F.conv(F.substring(stable_hash(F.lit(seed), F.lit("copy"), F.col("id")), 1, 12), 16, 10).cast("bigint") % n).alias("_n")
            )
            copies = draws.join(numbered, "_n").withColumns({"oversampled_train_reference": F.lit(True), "oversample_copy_index": F.col("_copy")}).drop("_n", "_copy")
            out = out.unionByName(copies)
    return out


def split_conflicts(splits: DataFrame, key: str) -> DataFrame:
    """(key, splits) of identities that stand in several splits; a final split must have none."""
    sets = splits.groupBy(key).agg(F.array_sort(F.collect_set("candidate_split")).alias("splits"))
    return sets.filter(F.size("splits") > 1)


def folds(df: DataFrame, specs: dict[str, Column]) -> DataFrame:
    """df with fold_id and held_out, once for each fold: a fold is a predicate that says what it holds out."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("fold_id"), F.coalesce(held, F.lit(False)).alias("held_out")) for name, held in specs.items()]))
    return df.withColumn("_fold", each).select("*", "_fold.*").drop("_fold")


def fold_parts(folded: DataFrame, klass: str, id_col: str, val_rows: int, seed: int) -> DataFrame:
    """folded with part: held-out rows test; of each class's others val_rows, in hash order, validate, and the rest train."""
    open_ = folded.filter(~F.col("held_out")).withColumn("_score", score(seed, "fold", id_col))
    near, far = by_hash(open_, ["fold_id", klass], "_score", val_rows)
    placed = ranked(near, ["fold_id", klass], ["_score", id_col], "_rank").withColumn("part", F.when(F.col("_rank") <= val_rows, "val").otherwise("train")).drop("_rank")
    parts = placed.unionByName(far.withColumn("part", F.lit("train"))).drop("_score")
    return parts.unionByName(folded.filter("held_out").withColumn("part", F.lit("test")))


def weighted_draws(groups: DataFrame, weight: str, members: str, draws: int, seed: int, order: Sequence[str]) -> DataFrame:
    """(draw, order..., member): draws with replacement by weight; groups is small and each of its rows stands for ``members`` rows.

    A draw's hash is looked up among the cumulative weights of the groups, and a second hash says which member of the group it
    is (from 0). Groups are (class, subtype, group) counts, so only those few are ordered and sent everywhere; draws are made
    in as many tasks as there are cores and never meet the rows themselves.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = groups.agg(F.sum(F.col(weight) * F.col(members)).alias("_total"))
    bounds = groups.withColumn("_upto", F.sum(F.col(weight) * F.col(members)).over(w)).crossJoin(F.broadcast(total))
    bounds = bounds.select(*order, members, ((F.col("_upto") - F.col(weight) * F.col(members)) / F.col("_total")).alias("_from"), (F.col("_upto") / F.col("_total")).alias("_to"))

    def uniform(salt):
        return F.conv(F.substring(stable_hash(F.lit(seed), F.lit(salt), F.col("draw")), 1, 12), 16, 10).cast("bigint")

    drawn = groups.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumns({"_u": uniform("group") / F.lit(float(1 << 48)), "_m": uniform("member")})
    hit = (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))
    return drawn.join(F.broadcast(bounds), hit).select("draw", *order, (F.col("_m") % F.col(members)).alias("member"))


def payload_facts(payloads: Column) -> Column:
    """What a record's packets hold: mean value of their bytes from 0 to 1, share of bytes and of packets that are not zero.

    payloads is an array of binaries; null ones do not count, and a record without a byte has 0 of all. Bytes are read as
    text of one character each, where they are, and never become rows.
    """
    text = F.transform(F.filter(F.coalesce(payloads, F.array().cast("array<binary>")), lambda b: b.isNotNull()), lambda b: F.decode(b, "ISO-8859-1"))
    # Of each packet its length, how many bytes are zero, and their sum.
    packets = F.transform(text, lambda t: F.struct(
        F.length(t).alias("size"), F.length(F.replace(t, F.lit("\0"), F.lit(""))).alias("filled"),
        F.aggregate(F.split(t, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.ascii(c)).alias("total"),
    ))

    def add(field: str) -> Column:
        return F.aggregate(packets, F.lit(0).cast("bigint"), lambda s, p: s + p[field])

    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return F.struct(
        part(add("total") / F.lit(255.0), add("size")).alias("mean"), part(add("filled"), add("size")).alias("nonzero"),
        part(F.size(F.filter(packets, lambda p: p["filled"] > 0)), F.size(packets)).alias("rows"),
    )


def payload_diagnostic(records: DataFrame, klass: str | None, payloads: str, heavy: Sequence[str] = ("WebBased", "BruteForce")) -> DataFrame:
    """Per class, or over all records without one, how dense the packets' payloads are, and whether that will do.

    The gate is for classes that live by their payloads: the mean of their records' mean byte values (payload_facts) must
    be 0.10 at least.
    """
    per = records.select((F.col(klass) if klass else F.lit("all")).alias("class_name"), payload_facts(F.col(payloads)).alias("f")).select("class_name", "f.*")
    share = F.avg("nonzero")
    # Bounds and names of what the share of filled bytes says, and the gate.
    kind = F.when(share < 0.10, "nearly_all_zero").when(share < 0.80, "sparse").otherwise("dense")
    gate = F.when(F.col("class_name").isin(*heavy) & (F.col("mean_value") < 0.10), "below_gate").otherwise("adequate")
    return per.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("records"), F.avg("mean").alias("mean_value"), F.min("mean").alias("least_value"), F.max("mean").alias("most_value"), F.count_if(F.col("mean") == 0).alias("zero_mean"),
        share.alias("mean_nonzero"), F.min("nonzero").alias("least_nonzero"), F.max("nonzero").alias("most_nonzero"),
        F.avg("rows").alias("mean_rows_with_payload"), F.min("rows").alias("least_rows_with_payload"), F.max("rows").alias("most_rows_with_payload"),
        F.count_if(F.col("rows") == 0).alias("without_payload"), kind.alias("interpretation"),
    ).withColumn("gate", gate)


def window_consistency(records: DataFrame, packets: str, nodes: str, limit: int) -> DataFrame:
    """One row: how many records count more packets than the limit but hold no more than that."""
    # The two conclusions.
    wrong = (F.col(packets) > limit) & (F.col(nodes) <= limit)
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(wrong).alias("mismatches"), (F.count_if(wrong) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share"),
        F.max(packets).alias("most_packets"), F.max(nodes).alias("most_nodes"),
        F.when(F.count_if(wrong) > 0, "mismatch_confirmed_rebuild_needed").otherwise("no_mismatch_observed_flowcapper_consistent").alias("conclusion"),
    )


def attribute_probe(packets: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """Per binary attribute of packets: seen, with bytes that are not zero, mean and greatest length; null is not seen."""
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("attribute"), c.alias("bytes")) for n, c in attributes.items()]))
    rows = packets.select(each).filter("bytes is not null")
    filled_bytes = F.regexp_like(F.hex("bytes"), F.lit("^(00)*(?!00)[0-9A-F]{2}"))
    return rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("seen"), F.count_if(filled_bytes).alias("nonzero"), F.avg(F.length("bytes")).alias("mean_length"), F.max(F.length("bytes")).alias("most_length"))


def padded(payload: Column, size: int = 1500) -> Column:
    """A payload cut or filled with zero bytes to a fixed size."""
    return F.rpad(F.substring(payload, 1, size), size, F.unhex(F.lit("00")))


def class_order(rows: DataFrame, klass: str, label: str) -> DataFrame:
    """(klass, label, place): classes in order of their least label, those without one after them by name."""
    per = rows.groupBy(klass).agg(F.min(label).alias("label"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.col("label").asc_nulls_last(), klass)) - 1)  # one row a class


def brightness(mean: Column) -> Column:
    """A colour for a packet by its payload's mean; null for none."""
    # Bounds and colours.
    return (
        F.when(mean.isNull(), "#b7c4cf").when(mean < 0.02, "#d7dee7").when(mean < 0.10, "#86b7fe").when(mean < 0.25, "#4dab8c").otherwise("#f59f00")
    )
