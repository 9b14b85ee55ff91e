"""Validation gates: rules over records, with counts of what breaks them, samples, and pass or fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ordered import first_per_key
from flowlens.scratch import cut


def broken(records: DataFrame, id_col: str, hard: dict[str, Column], soft: dict[str, Column] | None = None) -> DataFrame:
    """(id, reason, hard) for every rule that a record breaks; a rule is a condition that is true where it is broken."""
    rules = [(n, c, True) for n, c in hard.items()] + [(n, c, False) for n, c in (soft or {}).items()]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.struct(F.lit(n).alias("reason"), F.lit(h).alias("hard"))) for n, c, h in rules]))
    return records.select(F.col(id_col).alias("id"), F.inline(found))


def report(failures: DataFrame, sample: int = 200) -> DataFrame:
    """Per reason how many records break it, and the first ids of them."""
    counts = failures.groupBy("reason", "hard").agg(F.count(F.lit(1)).alias("n"))
    first = first_per_key(failures, ["reason"], ["id"], sample).groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    return counts.join(first, "reason")


def verdict(failures: DataFrame) -> DataFrame:
    """One row: pass or fail, hard failures and warnings; without any failure all is well."""
    return failures.agg(
        F.when(F.count_if("hard") > 0, "fail").otherwise("pass").alias("status"), F.count_if("hard").alias("hard_failures"), F.count_if(~F.col("hard")).alias("warnings")
    )


def registry_rules(kind: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(hard, soft) of the raw-data gate for files(required, exists, status, hashed, read_check) of a kind: csv or pcap."""
    # Names of the reasons, here and in the rules below.
    hard = {"missing_required_file": F.col("required") & ~F.col("exists")}
    soft = {"sha256_skipped": ~F.col("hashed")}
    if kind == "csv":
        hard["csv_error"] = F.col("status") == "error"
    else:
        hard |= {f"pcap_read_check_{x}": F.col("read_check") == x for x in ("error", "timeout")}
        soft |= {f"pcap_read_check_{x}": F.col("read_check") == x for x in ("skipped", "tool_unavailable")}
    return hard, soft


def finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def record_rules(classes: list[str], version: str, flow: int = 92, packet: int = 1500, most: int = 20, contain: int = 4) -> dict[str, Column]:
    """Hard rules of the compact-feature gate for records(candidate_identity, class_name, label, flow_feature_version, flow_x,
    packet_x, contain_edge_attr, link_edge_attr): packet_x is an array of binaries, edges are arrays (of arrays)."""
    expected = F.lit(None).cast("int")
    for k, name in enumerate(classes):
        expected = F.when(F.col("class_name") == name, k).otherwise(expected)
    n = F.size("packet_x")
    return {
        "missing_candidate_identity": F.coalesce("candidate_identity", F.lit("")) == "",
        "unknown_class_name": expected.isNull(),
        "label_class_mismatch": expected.isNotNull() & ~F.col("label").eqNullSafe(expected),
        "feature_version_mismatch": ~F.col("flow_feature_version").eqNullSafe(F.lit(version)),
        "flow_dim_mismatch": F.size("flow_x") != flow,
        "packet_count_out_of_range": ~n.between(1, most),
        "packet_dim_mismatch": F.exists("packet_x", lambda b: F.length(b) != packet),
        "contain_edge_shape_mismatch": (F.size("contain_edge_attr") != n) | F.exists("contain_edge_attr", lambda e: F.size(e) != contain),
        "link_edge_shape_mismatch": F.size("link_edge_attr") != F.greatest(n - 1, F.lit(0)),
        "flow_nonfinite": ~finite(F.col("flow_x")),
        "contain_edge_nonfinite": F.exists("contain_edge_attr", lambda e: ~finite(e)),
    }


def missing(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def graph_rules(classes: list[str], flow: int = 92, packet: int = 1500, contain: int = 4, link: int = 1) -> dict[str, Column]:
    """Hard rules of the graph gate for records(graph_id, class_name, label, node_types, edge_types, flow_x, packet_x,
    contain_edge_attr, link_edge_attr): types are arrays of names, features arrays of arrays."""
    expected = F.lit(None).cast("int")
    for k, name in enumerate(classes):
        expected = F.when(F.col("class_name") == name, k).otherwise(expected)
    n = F.size("packet_x")
    # Names of nodes and edges, and of the reasons.
    edges = F.array(F.lit("contains"), F.lit("rev_contains"))
    wanted = F.when(n > 1, F.concat(edges, F.array(F.lit("linked_to")))).otherwise(edges)
    width = lambda column, size: F.exists(column, lambda row: F.size(row) != size)
    rules = {
        "missing_graph_id": missing("graph_id"),
        "unknown_class_name": expected.isNull(),
        "label_class_mismatch": expected.isNotNull() & ~F.col("label").eqNullSafe(expected),
        "node_type_mismatch": ~F.array_sort(F.array_distinct("node_types")).eqNullSafe(F.array(F.lit("flow"), F.lit("packet"))),
        "edge_type_missing": F.size(F.array_except(wanted, "edge_types")) > 0,
        "flow_dim_mismatch": (F.size("flow_x") != 1) | width("flow_x", flow),
        "packet_dim_mismatch": (n < 1) | width("packet_x", packet),
        "contain_edge_shape_mismatch": (F.size("contain_edge_attr") != n) | width("contain_edge_attr", contain),
        "link_edge_shape_mismatch": (F.size("link_edge_attr") != F.greatest(n - 1, F.lit(0))) | width("link_edge_attr", link),
    }
    return rules | {f"{c}_nonfinite": F.exists(c, lambda row: ~finite(row)) for c in ("flow_x", "packet_x", "contain_edge_attr", "link_edge_attr")}


def split_rules(named_split: str, own_split: str, source: str, identity: str, flow_hash: str, graph_id: str) -> dict[str, Column]:
    """Hard rules of the leakage gate: the split that a record itself names, old rows outside train, and missing ids."""
    # Names of the reasons.
    return {
        "graph_split_attr_mismatch": ~F.coalesce(F.col(own_split), F.lit("")).eqNullSafe(F.col(named_split)),
        "cicids2017_graph_outside_train": F.lower(source).contains("2017") & (F.col(named_split) != "train"),
        "missing_office_candidate_identity": missing(identity), "missing_flow_id_hash": missing(flow_hash), "missing_graph_id": missing(graph_id),
    }


_RULE, _KEY, _CELL, _COUNT = range(4)


def pool_gate(
    records: DataFrame, id_col: str, split: str, hard: dict[str, Column], soft: dict[str, Column] | None = None, unique: Sequence[str] = (), apart: Sequence[str] = (),
    expected: tuple[str, Sequence, Sequence[str], bool] | None = None, counters: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(failures, counts) of a pool from one pass over its records and one shuffle.

    failures(reason, hard, detail, n): a row for each record that breaks a rule (detail: its id); for each repeated value of
    a unique column (duplicate_<column>; n: the records beyond the first); for each value of a column in apart that two
    splits share (cross_split_<column>_overlap, once for each pair, which comes first in detail); and for each class that a
    split has no record of (class_missing_from_split), where expected is (class column, classes, splits, whether that is
    hard). Null and empty values are not compared; a rule for missing ones says so.
    counts(name, value, n): how many records have each value of the counters.

    A record becomes a few narrow rows, which are combined before the shuffle, so a value that very many records share
    costs no task more than others. An empty pool fails by its missing classes only.
    """
    fact = lambda kind, name, value, hard=True: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(hard).alias("hard"))
    facts = [F.when(F.coalesce(c, F.lit(True)), fact(_RULE, n, F.col(id_col))) for n, c in hard.items()]
    facts += [F.when(F.coalesce(c, F.lit(True)), fact(_RULE, n, F.col(id_col), False)) for n, c in (soft or {}).items()]
    facts += [F.when(~missing(c), fact(_KEY, c, F.col(c))) for c in dict.fromkeys([*unique, *apart])]
    facts += [fact(_COUNT, n, c) for n, c in (counters or {}).items()]
    if expected:
        facts.append(fact(_CELL, "class", F.col(expected[0])))
    rows = records.select(F.col(split).alias("split"), F.inline(F.array_compact(F.array(*facts))))
    grouped = rows.groupBy("kind", "name", "value", "hard").agg(F.count(F.lit(1)).alias("n"), F.collect_set("split").alias("splits"))  # a few splits
    found = cut(grouped.filter((F.col("kind") != _KEY) | (F.col("n") > 1)), "gate")
    rules = found.filter(F.col("kind") == _RULE).select(F.col("name").alias("reason"), "hard", F.col("value").alias("detail"), "n")
    keys = found.filter(F.col("kind") == _KEY)
    repeats = keys.filter(F.col("name").isin(*unique)).select(F.concat(F.lit("duplicate_"), "name"), "hard", "value", F.col("n") - 1)
    sides = keys.filter(F.col("name").isin(*apart) & (F.size("splits") > 1)).withColumn("splits", F.array_sort("splits"))
    pairs = sides.select("name", "value", "hard", "splits", F.posexplode("splits").alias("i", "a")).select("name", "value", "hard", "a", F.explode(F.slice("splits", F.col("i") + 2, F.size("splits"))).alias("b"))
    shared = pairs.select(F.concat(F.lit("cross_split_"), "name", F.lit("_overlap")), "hard", F.concat("a", F.lit("__"), "b", F.lit(" "), "value"), F.lit(1).cast("bigint"))
    failures = rules.union(repeats).union(shared)
    if expected:
        _, classes, splits, is_hard = expected
        wanted = records.sparkSession.createDataFrame([(s, str(c)) for s in splits for c in classes], "split string, value string")
        seen = found.filter(F.col("kind") == _CELL).select("value", F.explode("splits").alias("split"))
        absent = wanted.join(seen, ["split", "value"], "left_anti")
        failures = failures.union(absent.select(F.lit("class_missing_from_split"), F.lit(is_hard), F.concat("split", F.lit(" "), "value"), F.lit(1).cast("bigint")))
    return failures, found.filter(F.col("kind") == _COUNT).select("name", "value", "n")


def gate_report(failures: DataFrame, sample: int = 200) -> DataFrame:
    """(reason, hard, n, sample) of pool_gate's failures: how many there are by reason, and the first details of them."""
    counts = failures.groupBy("reason", "hard").agg(F.sum("n").alias("n"))
    first = first_per_key(failures, ["reason"], ["detail"], sample).groupBy("reason").agg(F.array_sort(F.collect_list("detail")).alias("sample"))
    return counts.join(first, "reason")


def leaks(records: DataFrame, split: str, keys: list[str], id_col: str) -> DataFrame:
    """(id, reason, hard) of the split-leakage gate: records whose key stands in another split too, for each of the keys.

    All keys are looked up in one pass: values that splits share are found first, then each record's keys among them.
    """
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    rows = records.select(F.col(id_col).alias("id"), F.col(split).alias("split"), each).filter("value is not null")
    shared = rows.groupBy("key", "value").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi").select("key", "value")
    found = rows.join(shared, ["key", "value"], "left_semi")
    return found.select("id", F.concat("key", F.lit("_shared_by_splits")).alias("reason"), F.lit(True).alias("hard"))


def wrong_widths(df: DataFrame, id_col: str, widths: dict[str, int]) -> DataFrame:
    """(id, reason, hard) of rows whose arrays are not of the widths that a model takes."""
    return broken(df, id_col, {f"{c}_width": F.size(c) != n for c, n in widths.items()})
