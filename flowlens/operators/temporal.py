"""The trailing features of a flow: what the last flows to the same destination were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import vocabulary as V
from flowlens.functions.scalars import number
from flowlens.operators.halo import trailing_features

# Names under which files have the fields of a flow, the first that is there and not null counts.
ALIASES = {
    "dst_ip": ("dst_ip", "Dst IP", "Destination IP", "Destination", "dest_ip"),
    "src_port": ("src_port", "Src_Port", "Src Port", "Source Port", "sport"),
    "dst_port": ("dst_port", "Dst_Port", "Dst Port", "Destination Port", "dport"),
    "protocol": ("protocol", "Protocol", "Protocol Type"),
    "udp": ("UDP",), "tcp": ("TCP",), "icmp": ("ICMP",), "dns": ("DNS",),
    "ack": ("ack_count", "ack_flag_number", "ACK Flag Cnt"),
    "fin": ("fin_count", "fin_flag_number", "FIN Flag Cnt"),
    "rst": ("rst_count", "rst_flag_number", "RST Flag Cnt"),
    "psh": ("psh_flag_number", "PSH Flag Cnt"),
    "syn": ("syn_count", "syn_flag_number", "SYN Flag Cnt"),
    "duration": ("Flow_Duration", "Flow Duration", "Duration", "IAT"),
    "total": ("Number", "Total Packets"),
}
PACKET_PARTS = ("Fwd_Packet_Count", "Bwd_Packet_Count", "Tot Fwd Pkts", "Tot Bwd Pkts")
# Ports that service flags stand for where a row has no port.
SERVICE_PORTS = (("HTTP", 80), ("HTTPS", 443), ("DNS", 53), ("Telnet", 23), ("SSH", 22), ("SMTP", 25))
# How a flow's fields are called in trailing features.
RENAMED = {
    "Dst IP": "dst_ip", "Src Port": "src_port", "Dst Port": "dst_port", "Protocol": "protocol", "ACK Flag Cnt": "bidirectional_ack_packets",
    "FIN Flag Cnt": "bidirectional_fin_packets", "RST Flag Cnt": "bidirectional_rst_packets", "PSH Flag Cnt": "bidirectional_psh_packets",
    "SYN Flag Cnt": "bidirectional_syn_packets", "Tot Fwd Pkts": "src2dst_packets", "Tot Bwd Pkts": "dst2src_packets",
}


def renamed(flows: DataFrame) -> DataFrame:
    """Extracted flows under the names that trailing features read: counts by name, the duration in microseconds; absent fields are 0."""
    there, taken = set(flows.columns), {c.lower() for c in flows.columns}
    fields = [(F.col(old) if old in there else F.lit(0)).alias(new) for new, old in RENAMED.items() if new.lower() not in taken]
    duration = F.col("bidirectional_duration_ms") if "bidirectional_duration_ms" in there else F.lit(0)
    return flows.select("*", *fields, (number(duration) * 1000.0).alias("Flow Duration"))


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    there = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def snapshot(df: DataFrame) -> DataFrame:
    """df with a struct ``snap`` of what the windows add up.

    A missing port is that of the service flag which is set; UDP, TCP and ICMP fall back on the protocol number; packets
    are both directions' counts, or a total. Of the flags HTTP and HTTPS the first one that is not null counts. A null
    destination is "global".
    """

    def n(name):
        return number(_first(df, ALIASES[name]))

    def flag(name):
        return number(_first(df, (name,)))

    port_text, protocol = _first(df, ALIASES["dst_port"]), n("protocol").cast("int")
    by_service = F.lit(0)
    for name, p in reversed(SERVICE_PORTS):
        by_service = F.when(flag(name) > 0, p).otherwise(by_service)
    port = F.when(port_text.isNotNull(), number(port_text).cast("int")).otherwise(by_service)

    def by_protocol(name, p):
        return F.when(n(name) != 0, n(name)).otherwise((protocol == p).cast("double"))

    parts = F.lit(0.0)
    for part in PACKET_PARTS:
        parts = parts + number(_first(df, (part,)))
    fields = {
        "udp": by_protocol("udp", 17), "tcp": by_protocol("tcp", 6), "ack": n("ack"), "fin": n("fin"), "rst": n("rst"), "psh": n("psh"), "syn": n("syn"), "icmp": by_protocol("icmp", 1),
        "http_port": (port.isin(*V.HTTP_PORTS) | (number(_first(df, ("HTTP", "HTTPS"))) > 0)).cast("double"), "duration": n("duration"),
        "dns": ((port == 53) | (n("dns") > 0)).cast("double"), "vulnerable": port.isin(*V.VULNERABLE_PORTS).cast("double"),
        "packets": F.when(parts != 0, parts).otherwise(n("total")), "source_port": n("src_port").cast("int"),
    }
    return df.withColumns({"snap": F.struct(*[c.alias(k) for k, c in fields.items()]), "snap_key": F.coalesce(_first(df, ALIASES["dst_ip"]), F.lit("global"))})


def temporal_features(df: DataFrame, order: list[str], scope: list[str] | None = None, rows: int = 375) -> DataFrame:
    """df with ``temporal``, the array of trailing features in their order, over the ``rows`` flows before each one to its destination.

    order is that in which flows count as before each other: emission (file, place in it) or time. scope columns start
    windows anew (a capture day, a subtype). Two features are under two names each, one of them in another case only, so
    the features are places of an array and not columns.
    """
    summed = {
        "UDP_Sum": "udp", "TCP_Sum": "tcp", "ACK_Sum": "ack", "FIN_Sum": "fin", "RST_Sum": "rst", "psh_Sum": "psh", "SYN_Sum": "syn", "ICMP_Sum": "icmp",
        "http_port": "http_port", "DNS_Sum": "dns", "vulnerable_port": "vulnerable", "packets_Sum": "packets",
    }
    twice = {"Rolling_fin_Sum": "Rolling_FIN_Sum", "Rolling_bipackets_Sum": "Rolling_packets_Sum"}  # one number under two names
    at = {f"Rolling_{name}": f"t{k}" for k, name in enumerate(summed)} | {"Rolling_Average_Duration": "mean", "Unique_Ports_In_SourceDestination": "ports"}
    snap = lambda field: F.col(f"snap.{field}")
    found = trailing_features(
        snapshot(df), [*(scope or []), "snap_key"], order, rows,
        {at[f"Rolling_{name}"]: snap(field) for name, field in summed.items()},
        {"mean": snap("duration")},
        {"ports": F.when(snap("source_port") != 0, snap("source_port"))},
        columns=df.columns,
    )
    values = [F.col(at[twice.get(name, name)]).cast("double") for name in V.TEMPORAL_FEATURES]
    return found.select(*df.columns, F.array(*values).alias("temporal"))


def feature_vector(df: DataFrame) -> Column:
    """The ordered vector of a flow: its 76 features, then the trailing ones (``temporal``); absent columns and nulls are 0."""
    there, zero = set(df.columns), F.lit(0.0).cast("float")
    own = F.array(*[F.coalesce(F.col(n).cast("float"), zero) if n in there else zero for n in V.flow_features()])
    last = F.transform("temporal", lambda x: F.coalesce(x.cast("float"), zero)) if "temporal" in there else F.array_repeat(zero, len(V.TEMPORAL_FEATURES))
    return F.concat(own, last)


def ablated(vector: Column, variant: str) -> Column:
    """The ordered vector with the features that a variant leaves out as 0.

    no_temporal and temporal_only part flow from trailing features; flow_only and full keep all of the vector (what they
    leave out is the packets); packet_only keeps none of it; no_ports and no_protocol drop those.
    """
    names = (*V.flow_features(), *V.TEMPORAL_FEATURES)
    temporal = {i for i, n in enumerate(names) if n in V.TEMPORAL_FEATURES}
    every = set(range(len(names)))
    # Names of the variants.
    hidden = {
        "full": set(), "no_temporal": temporal, "temporal_only": every - temporal, "flow_only": set(), "no_packet_payload": set(), "packet_only": every,
        "no_ports": {i for i, n in enumerate(names) if n in ("src_port", "dst_port", "Unique_Ports_In_SourceDestination")}, "no_protocol": {names.index("protocol")},
    }
    if variant not in hidden:
        raise ValueError(f"variant is one of {sorted(hidden)}")
    if not hidden[variant]:
        return vector
    places = F.array(*[F.lit(i) for i in sorted(hidden[variant])])
    return F.transform(vector, lambda x, i: F.when(F.array_contains(places, i), F.lit(0.0).cast("float")).otherwise(x))
