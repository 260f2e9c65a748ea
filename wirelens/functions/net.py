"""Packet predicates and address functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens.schemas import FLAG_NAMES

# Fixed values of the detection rules.
DNS_PORT = 53
WEB_PORTS = [80, 443]
MALICIOUS_PORTS = [4444, 5555, 8888, 1337, 31337, 6667, 6697]


def is_protocol(name: str, column: str = "protocol") -> Column:
    return F.upper(column) == name


def is_dns() -> Column:
    """DNS by label, or anything sent to port 53."""
    return is_protocol("DNS") | (F.col("dst_port") == DNS_PORT)


def has_flags(*names: str) -> Column:
    test = F.array_contains("tcp_flags", names[0])
    for name in names[1:]:
        test = test & F.array_contains("tcp_flags", name)
    return test


def is_syn_only() -> Column:
    return has_flags("SYN") & ~has_flags("ACK")


def is_xmas() -> Column:
    return has_flags("FIN", "PSH", "URG")


def is_web() -> Column:
    return F.col("dst_port").isin(WEB_PORTS)


def is_internal_ip(ip: Column | str) -> Column:
    """RFC 1918 ranges by the octets; anything but four integers is external."""
    parts = F.split(ip, r"\.", -1)
    octets = [F.trim(F.get(parts, F.lit(i))).try_cast("bigint") for i in range(4)]
    well_formed = (F.size(parts) == 4) & octets[0].isNotNull()
    for octet in octets[1:]:
        well_formed = well_formed & octet.isNotNull()
    private = (
        (octets[0] == 10)
        | ((octets[0] == 172) & octets[1].between(16, 31))
        | ((octets[0] == 192) & (octets[1] == 168))
    )
    return F.coalesce(well_formed & private, F.lit(False))


def protocol_label(has_dns: Column, has_tcp: Column, has_udp: Column, has_icmp: Column) -> Column:
    """One label per packet; the application layer wins over the transport layer."""
    return (
        F.when(has_dns, "DNS").when(has_tcp, "TCP").when(has_udp, "UDP").when(has_icmp, "ICMP")
    ).otherwise("OTHER")


def flag_names(letters: Column | str) -> Column:
    """Flag letters such as `SA` as names; letters without a name are dropped."""
    names = F.create_map(*[F.lit(x) for pair in FLAG_NAMES.items() for x in pair])
    named = F.transform(F.split(letters, ""), lambda ch: F.try_element_at(names, ch))
    return F.filter(named, lambda name: name.isNotNull())


def packet_filter(
    *,
    protocols: list[str] | None = None,
    host: str | None = None,
    src: str | None = None,
    dst: str | None = None,
    port: int | None = None,
    dst_port: int | None = None,
    since_us: int | None = None,
    until_us: int | None = None,
) -> Column:
    """Conjunction of plain column predicates, all of which reach the Parquet scan."""
    tests = [F.lit(True)]
    if protocols is not None:
        tests.append(F.col("protocol").isin(protocols))
    if host is not None:
        tests.append((F.col("src_ip") == host) | (F.col("dst_ip") == host))
    if src is not None:
        tests.append(F.col("src_ip") == src)
    if dst is not None:
        tests.append(F.col("dst_ip") == dst)
    if port is not None:
        tests.append((F.col("src_port") == port) | (F.col("dst_port") == port))
    if dst_port is not None:
        tests.append(F.col("dst_port") == dst_port)
    if since_us is not None:
        tests.append(F.col("ts_us") >= since_us)
    if until_us is not None:
        tests.append(F.col("ts_us") < until_us)
    combined = tests[0]
    for test in tests[1:]:
        combined = combined & test
    return combined


def set_signature(ip: Column | str) -> tuple[Column, Column]:
    """Two order-free 64-bit aggregates that identify a set of distinct addresses."""
    value = F.col(ip) if isinstance(ip, str) else ip
    return F.bit_xor(F.xxhash64(value)), F.bit_xor(F.xxhash64(F.lit("set"), value))


def signature_text(n: Column, first: Column, second: Column) -> Column:
    return F.concat_ws(":", n.cast("string"), F.hex(first), F.hex(second))


def single_signature(ip: Column | str) -> Column:
    """Signature of a set with one address, equal to what the aggregates give."""
    value = F.col(ip) if isinstance(ip, str) else ip
    return signature_text(F.lit(1), F.xxhash64(value), F.xxhash64(F.lit("set"), value))
