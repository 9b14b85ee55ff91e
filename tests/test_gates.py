"""Gates, payload density and trailing snapshots against worked cases."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import gates as G
from flowlens.operators import pools, temporal

GRAPH = "id int, split string, graph_id string, class_name string, label int, node_types array<string>, edge_types array<string>, flow_x array<array<double>>, packet_x array<array<double>>, contain_edge_attr array<array<double>>, link_edge_attr array<array<double>>"
GOOD = dict(split="train", graph_id="g", class_name="a", label=0, node_types=["packet", "flow"], edge_types=["contains", "rev_contains", "linked_to"], flow_x=[[0.0] * 3], packet_x=[[0.0] * 2] * 2, contain_edge_attr=[[0.0] * 4] * 2, link_edge_attr=[[0.0]])


def graphs(spark, *changes):
    rows = [{"id": k, **GOOD, "graph_id": f"g{k}", **c} for k, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in GRAPH.split(", ")) for r in rows], GRAPH)


@pytest.mark.parametrize(("change", "reason"), [
    ({"graph_id": ""}, "missing_graph_id"), ({"graph_id": None}, "missing_graph_id"), ({"class_name": "z"}, "unknown_class_name"), ({"class_name": None}, "unknown_class_name"), ({"label": 1}, "label_class_mismatch"),
    ({"label": None}, "label_class_mismatch"), ({"node_types": ["flow"]}, "node_type_mismatch"), ({"edge_types": ["contains", "rev_contains"]}, "edge_type_missing"), ({"flow_x": [[0.0] * 4]}, "flow_dim_mismatch"),
    ({"flow_x": [[0.0] * 3] * 2}, "flow_dim_mismatch"), ({"packet_x": [[0.0] * 2, [0.0]]}, "packet_dim_mismatch"), ({"contain_edge_attr": [[0.0] * 4]}, "contain_edge_shape_mismatch"),
    ({"link_edge_attr": []}, "link_edge_shape_mismatch"), ({"flow_x": [[0.0, float("nan"), 0.0]]}, "flow_x_nonfinite"), ({"packet_x": [[0.0, float("inf")], [0.0] * 2]}, "packet_x_nonfinite"),
    ({"contain_edge_attr": [[None, 0.0, 0.0, 0.0], [0.0] * 4]}, "contain_edge_attr_nonfinite"), ({"link_edge_attr": [[float("-inf")]]}, "link_edge_attr_nonfinite"),
])
def test_graph_reasons(spark, change, reason):
    failures, _ = G.pool_gate(graphs(spark, {}, change), "id", "split", G.graph_rules(["a", "b"], flow=3, packet=2), unique=["graph_id"])
    assert [(r.reason, r.detail, r.n) for r in failures.collect()] == [(reason, "1", 1)]


def test_graph_sets_and_counts(spark):
    df = graphs(spark, {"graph_id": "x"}, {"graph_id": "x", "split": "val"}, {"graph_id": "x"}, {"class_name": "b", "label": 1}, {"graph_id": ""}, {"graph_id": ""})
    failures, counts = G.pool_gate(
        df, "id", "split", {}, {"odd": F.col("id") % 2 == 1}, unique=["graph_id"], apart=["graph_id"], expected=("class_name", ["a", "b"], ["train", "val", "test"], True),
        counters={"per_class": F.concat_ws("|", "split", "class_name")},
    )
    got = sorted((r.reason, r.hard, r.detail, r.n) for r in failures.collect())
    assert got == [
        ("class_missing_from_split", True, "test a", 1), ("class_missing_from_split", True, "test b", 1), ("class_missing_from_split", True, "val b", 1),
        ("cross_split_graph_id_overlap", True, "train__val x", 1), ("duplicate_graph_id", True, "x", 2), ("odd", False, "1", 1), ("odd", False, "3", 1), ("odd", False, "5", 1),
    ]
    assert {r.value: r.n for r in counts.collect()} == {"train|a": 4, "val|a": 1, "train|b": 1}
    report = {r.reason: (r.n, r.sample) for r in G.gate_report(failures, 2).collect()}
    assert report["odd"] == (3, ["1", "3"]) and report["duplicate_graph_id"] == (2, ["x"])
    empty, _ = G.pool_gate(df.limit(0), "id", "split", {"x": F.lit(True)}, unique=["graph_id"], expected=("class_name", ["a"], ["train"], False))
    assert [(r.reason, r.hard) for r in empty.collect()] == [("class_missing_from_split", False)]


def test_split_reasons(spark):
    rows = [(0, "train", "train", "CIC2017", "i", "h", "g"), (1, "val", "train", "CIC-2017x", "j", "k", "l"), (2, "val", None, "s", None, "", "m")]
    df = spark.createDataFrame(rows, "id int, split string, own string, source string, identity string, hash string, graph string")
    failures, _ = G.pool_gate(df, "id", "split", G.split_rules("split", "own", "source", "identity", "hash", "graph"), unique=["identity", "graph"], apart=["identity", "hash", "graph"])
    assert sorted((r.reason, r.detail) for r in failures.collect()) == [
        ("cicids2017_graph_outside_train", "1"), ("graph_split_attr_mismatch", "1"), ("graph_split_attr_mismatch", "2"), ("missing_flow_id_hash", "2"), ("missing_office_candidate_identity", "2"),
    ]


def test_leaks_in_one_pass(spark):
    df = spark.createDataFrame([(1, "train", "a", 5), (2, "val", "a", 6), (3, "val", None, 6), (4, "test", None, 5)], "id int, split string, k string, m int")
    got = sorted((r.id, r.reason) for r in G.leaks(df, "split", ["k", "m"], "id").collect())
    assert got == [(1, "k_shared_by_splits"), (1, "m_shared_by_splits"), (2, "k_shared_by_splits"), (4, "m_shared_by_splits")]


def test_payload_means(spark):
    rows = [("WebBased", [b"\x01" * 10]), ("BruteForce", [b"\xff", None, b"\x00"]), ("Benign", [b"\x00\x01", None]), ("DoS", []), ("DDoS", None), ("Bot", [None, b""]), ("Recon", [bytes(range(256)) * 50])]
    got = {r.class_name: r for r in pools.payload_diagnostic(spark.createDataFrame(rows, "c string, p array<binary>"), "c", "p").collect()}
    assert got["WebBased"].gate == "below_gate" and got["WebBased"].mean_nonzero == 1.0 and abs(got["WebBased"].mean_value - 1 / 255) < 1e-12
    assert (got["BruteForce"].mean_value, got["BruteForce"].mean_nonzero, got["BruteForce"].mean_rows_with_payload, got["BruteForce"].gate) == (0.5, 0.5, 0.5, "adequate")
    assert (got["Benign"].mean_nonzero, got["Benign"].mean_rows_with_payload, got["Benign"].gate) == (0.5, 1.0, "adequate")
    for name in ("DoS", "DDoS", "Bot"):
        assert (got[name].mean_value, got[name].mean_nonzero, got[name].mean_rows_with_payload, got[name].zero_mean, got[name].without_payload) == (0.0, 0.0, 0.0, 1, 1)
    assert abs(got["Recon"].mean_value - 0.5) < 1e-12 and abs(got["Recon"].mean_nonzero - 255 / 256) < 1e-12
    [whole] = pools.payload_diagnostic(spark.createDataFrame(rows[:2], "c string, p array<binary>"), None, "p").collect()
    assert whole.records == 2 and whole.class_name == "all"


@pytest.mark.parametrize(("http", "https", "port", "flag"), [(0, 1, 9443, 0.0), (None, 1, 9443, 1.0), (1, 0, 9443, 1.0), (0, 0, 443, 1.0), (0, 1, None, 1.0)])
def test_http_flag(spark, http, https, port, flag):
    """Of HTTP and HTTPS the first that is there counts; a missing port is that of the flag that is set."""
    df = spark.createDataFrame([(http, https, port)], "HTTP int, HTTPS int, dst_port int")
    assert temporal.snapshot(df).first().snap.http_port == flag
