"""Scalar functions, all Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def compact(text: Column) -> Column:
    """Lower case without anything but letters a-z and digits."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def number(value: Column) -> Column:
    """A finite double; null, text that is no number, NaN and infinities become 0."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def integer(value: Column) -> Column:
    return F.coalesce(number(value).cast("bigint"), F.lit(0))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, or 0 where that is no finite number."""
    return number(F.try_divide(a.cast("double"), b.cast("double")))


def parsed_time(text: Column) -> Column:
    """ISO first, then two plain formats; null if none fits."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone (UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds, half to even."""
    return F.bround(micros(ts) / F.lit(1000.0)).cast("bigint")


def piped(*parts: Column) -> Column:
    """Parts as text joined with |, null as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the piped parts: the identity of a flow and, with seed and salt in front, the order of samples."""
    return F.sha2(piped(*parts), 256)


def key_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as canonical JSON, names in order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def undirected_hash(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column, protocol: Column, ts: Column, bucket_ms: int) -> Column:
    """The same hash for both directions of a flow, with its start in buckets of bucket_ms; ports compare as numbers."""
    one, two = (F.struct(i.alias("ip"), p.cast("bigint").alias("port")) for i, p in ((ip_a, port_a), (ip_b, port_b)))
    low, high = F.least(one, two), F.greatest(one, two)
    bucket = F.floor(epoch_millis(ts) / bucket_ms)
    return stable_hash(low["ip"], low["port"], high["ip"], high["port"], protocol, bucket)


def normal_mac(text: Column) -> Column:
    """aa:bb:cc:dd:ee:ff from any usual notation; null if it has no twelve hexadecimal digits."""
    parts = F.split(F.lower(F.trim(text)), "[:-]")
    padded = F.when(F.size(parts) == 6, F.array_join(F.transform(parts, lambda p: F.lpad(p, 2, "0")), "")).otherwise(F.lower(F.trim(text)))
    digits = F.regexp_replace(padded, r"[.:\s-]", "")
    return F.when(F.regexp_like(digits, F.lit("^[0-9a-f]{12}$")), F.regexp_replace(digits, "(..)(?=.)", "$1:"))


def ip_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    p = F.split(text, r"\.")
    ok = F.regexp_like(text, F.lit(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"))
    return F.when(ok, p[0].cast("bigint") * 16777216 + p[1].cast("bigint") * 65536 + p[2].cast("bigint") * 256 + p[3].cast("bigint"))


#: IPv4 ranges that are not global (network, prefix length).
PRIVATE_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
)


def is_ip(text: Column) -> Column:
    """Whether a text is an IPv4 address or an IPv6 one, short forms and such that end with an IPv4 address included; null is none."""
    t = F.lower(text)
    tail = F.regexp_extract(t, r":([0-9]+(?:\.[0-9]+){3})$", 1)
    six = F.when(tail == "", t).when(ip_number(tail).isNotNull(), F.regexp_replace(t, r"[0-9.]+$", "0:0")).otherwise("")
    group = "[0-9a-f]{1,4}"
    short = F.regexp_like(six, F.lit(f"^(({group}:)*{group})?::(({group}:)*{group})?$")) & (F.size(F.filter(F.split(six, ":"), lambda g: g != "")) <= 7)
    return F.coalesce(ip_number(text).isNotNull() | F.regexp_like(six, F.lit(f"^({group}:){{7}}{group}$")) | short, F.lit(False))


def is_private_ip(text: Column) -> Column:
    n = ip_number(text)
    inside = F.lit(False)
    for network, bits in PRIVATE_RANGES:
        a, b, c, d = map(int, network.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(inside, F.lit(False))


def ip_in_name(name: Column) -> Column:
    """The first dotted quad of a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"(\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension and without digits at its end."""
    return F.regexp_replace(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), "[0-9]+$", "")


def payload_text(payload: Column) -> Column:
    """Bytes as Latin-1 text without the zero bytes at the end."""
    return F.regexp_replace(F.decode(payload, "ISO-8859-1"), "\u0000+$", "")


def excerpt(text: Column, limit: int = 220) -> Column:
    return F.substring(squeezed(text), 1, limit)


def capped_log(x: Column) -> Column:
    """log(1 + x) with null and NaN as 0, infinity as the largest 32-bit float, negatives as 0."""
    clean = F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    return F.log1p(F.least(F.greatest(clean, F.lit(0.0)), F.lit(3.4028234663852886e38)))


def array_facts(a: Column) -> Column:
    """mean, population deviation, least and largest of a numeric array; zeros for an empty one."""
    n = F.size(a)
    values = F.transform(a, lambda x: x.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    zero = F.lit(0.0)
    return F.when(n > 0, F.struct(mean.alias("mean"), spread.alias("std"), F.array_min(values).alias("least"), F.array_max(values).alias("most"))).otherwise(
        F.struct(zero.alias("mean"), zero.alias("std"), zero.alias("least"), zero.alias("most"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance of two arrays; 1 if either is all zeros."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - safe_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def warmup_cosine(epoch: Column, warmup: int, period: int) -> Column:
    """Learning-rate factor: linear ramp, then cosine cycles of a fixed period."""
    inside = F.pmod(epoch - warmup, F.lit(period)) / F.lit(period)
    return F.when(epoch < warmup, (epoch + 1) / F.lit(warmup)).otherwise((1 + F.cos(inside * F.pi())) / 2)
