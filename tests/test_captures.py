"""Capture files made here byte by byte, read whole and in parts."""

import struct

import pandas as pd
import pytest

from wirelens.sources import captures
from wirelens.sources.captures import CaptureSource, read_captures
from wirelens.sources.frames import decode_frames

T = 1773568800


def ipv4(proto, body, src="10.0.0.1", dst="203.0.113.7", fragment=0):
    address = lambda ip: bytes(int(p) for p in ip.split("."))
    return (
        struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0)
        + address(src) + address(dst) + body
    )


def tcp(sport, dport, flags, body=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + body


def udp(sport, dport, body=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def ethernet(packet, kind=0x0800):
    return bytes(12) + struct.pack(">H", kind) + packet


FRAMES = [
    ethernet(ipv4(6, tcp(1234, 80, 0x02))),
    ethernet(ipv4(6, tcp(80, 1234, 0x12, b"hi"))),
    ethernet(ipv4(17, udp(5000, 53, b"query"))),
    ethernet(ipv4(17, udp(5000, 53))),
    ethernet(ipv4(1, b"\x08" + bytes(7))),
    ethernet(ipv4(47, bytes(4))),
    ethernet(bytes(40), 0x86DD),
    ethernet(ipv4(6, bytes(24), fragment=100)),
    ethernet(struct.pack(">HH", 5, 0x0800) + ipv4(6, tcp(1, 2, 0x29)), 0x8100),
]
EXPECTED = [
    ("TCP", 1234, 80, ["SYN"], 20),
    ("TCP", 80, 1234, ["SYN", "ACK"], 22),
    ("DNS", 5000, 53, [], 13),
    ("UDP", 5000, 53, [], 8),
    ("ICMP", 0, 0, [], 8),
    ("OTHER", 0, 0, [], 4),
    ("OTHER", 0, 0, [], 24),
    ("TCP", 1, 2, ["FIN", "PSH", "URG"], 40),
]


def pcap(frames, order="<", nanos=False, link=1):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        frac = i * (1000 if nanos else 1)
        out += struct.pack(order + "IIII", T + i, frac, len(f), len(f)) + f
    return out


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    size = 12 + len(body)
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def pcapng(frames, order="<"):
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535), order)
    nanos = struct.pack(order + "HHB3x", 9, 1, 9) + bytes(4)
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535) + nanos, order)
    for i, f in enumerate(frames):
        which = i % 2
        ticks = (T + i) * (10**9 if which else 10**6) + i * (1000 if which else 1)
        head = struct.pack(order + "IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f))
        out += block(6, head + f, order) + block(5, bytes(8), order)
    return out


def rows(df):
    return [
        (r["protocol"], r["src_port"], r["dst_port"], r["tcp_flags"], r["payload_size"])
        for r in df.orderBy("capture_id", "seq").collect()
    ]


@pytest.mark.parametrize(
    "name,data",
    [
        ("a.pcap", pcap(FRAMES)),
        ("b.pcap", pcap(FRAMES, ">")),
        ("c.pcap", pcap(FRAMES, nanos=True)),
        ("d.pcapng", pcapng(FRAMES)),
        ("e.PCAPNG", pcapng(FRAMES, ">")),
    ],
)
def test_formats(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    got = read_captures(spark, str(tmp_path))
    assert rows(got) == EXPECTED
    first = got.orderBy("seq").collect()
    assert [r["ts_us"] for r in first[:3]] == [(T + i) * 1_000_000 + i for i in range(3)]
    assert first[0]["src_ip"] == "10.0.0.1" and first[0]["size"] == len(FRAMES[0])


def test_parts_give_the_same_as_the_whole(spark, tmp_path):
    for name, data in (("a.pcap", pcap(FRAMES * 50)), ("b.pcapng", pcapng(FRAMES * 50))):
        (tmp_path / name).write_bytes(data)
    whole = read_captures(spark, str(tmp_path))
    parts = read_captures(spark, str(tmp_path), part_bytes=200)
    assert len(captures._parts(str(tmp_path / "a.pcap"), 200, "FAILFAST")) > 20
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert whole.count() == 2 * 50 * len(EXPECTED)
    assert parts.rdd.getNumPartitions() > 8


def test_raw_ip_and_payload_modes(spark, tmp_path):
    packets = [ipv4(6, tcp(1, 2, 0x18, b"12345")), ipv4(17, udp(1, 9, b"123"))]
    (tmp_path / "raw.pcap").write_bytes(pcap(packets, link=101))
    assert [r[4] for r in rows(read_captures(spark, str(tmp_path)))] == [5, 3]
    (tmp_path / "raw.pcap").write_bytes(pcap([ethernet(p) for p in packets]))
    assert [r[4] for r in rows(read_captures(spark, str(tmp_path)))] == [25, 11]
    assert [r[4] for r in rows(read_captures(spark, str(tmp_path), payload_mode="l4"))] == [5, 3]


def test_cooked_frames(spark, tmp_path):
    cooked = bytes(14) + struct.pack(">H", 0x0800) + ipv4(6, tcp(7, 8, 0x04))
    (tmp_path / "sll.pcap").write_bytes(pcap([cooked], link=113))
    assert rows(read_captures(spark, str(tmp_path))) == [("TCP", 7, 8, ["RST"], 20)]


def test_truncated_last_record_is_left_out(spark, tmp_path):
    (tmp_path / "cut.pcap").write_bytes(pcap(FRAMES[:3])[:-30] )
    assert len(rows(read_captures(spark, str(tmp_path)))) >= 2


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_captures(spark, str(tmp_path / "missing"))
    (tmp_path / "bad.pcap").write_bytes(b"this is not a capture")
    with pytest.raises(Exception, match="Not a valid capture"):
        read_captures(spark, str(tmp_path)).count()
    (tmp_path / "empty.pcap").write_bytes(pcap([]))
    (tmp_path / "good.pcap").write_bytes(pcap(FRAMES))
    assert read_captures(spark, str(tmp_path), errors="DROP").count() == len(EXPECTED)


def test_data_source(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES))
    (tmp_path / "b.pcapng").write_bytes(pcapng(FRAMES))
    spark.dataSource.register(CaptureSource)
    got = spark.read.format("capture").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 2
    assert rows(got) == EXPECTED * 2


def test_large_frames_come_in_batches_of_bounded_size(spark):
    head = "00" * 12 + "0800" + "4500ea74000000004011" + "0000" + "0a000001" + "0a000002"
    frames = spark.range(0, 300, 1, 1).selectExpr(
        "'c' as capture_id", "id as seq", "id as ts_us", "1 as link",
        f"unhex(concat('{head}', '0400', '0401', 'ea600000', repeat('00', 59992))) as frame",
    )
    packets = decode_frames(frames)
    batches = frames.mapInPandas(
        lambda found: (pd.DataFrame({"bytes": [pdf["frame"].map(len).sum()]}) for pdf in found), "bytes long"
    )
    assert max(r["bytes"] for r in batches.collect()) < 5e6 and packets.count() == 300
