"""Captured frames to packet rows, many at a time with numpy.

Works on one buffer of bytes plus arrays of offsets, lengths and link types. It is the small helper
that runs inside Spark tasks, for capture files as well as for tables of raw frames.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wirelens.schemas import FLAG_NAMES, PACKETS
from wirelens.session import adopt

# Fixed values of the link layers and protocols.
ETHERNET, COOKED, COOKED_V2, LOOPBACK = 1, 113, 276, (0, 108)
RAW_IP = (12, 14, 101, 228)
ETHERTYPE_IPV4, VLAN_TYPES = 0x0800, (0x8100, 0x88A8)
TCP, UDP, ICMP = 6, 17, 1
DNS_UDP_PORTS, DNS_TCP_PORTS = (53, 5353), (53,)
FLAG_BITS = "FSRPAU"  # bit 0 to bit 5 of the TCP flags byte

PACKET_SCHEMA = PACKETS


def _flag_table() -> list[list[str]]:
    return [
        [FLAG_NAMES[letter] for bit, letter in enumerate(FLAG_BITS) if value >> bit & 1]
        for value in range(64)
    ]


def decode(
    data: np.ndarray,
    offset: np.ndarray,
    captured: np.ndarray,
    link: np.ndarray,
    payload_mode: str = "reference",
) -> pd.DataFrame:
    """IPv4 packets among the frames, with `row`, the position of the frame.

    payload_mode `reference` counts the bytes inside the second layer of the frame: the transport
    segment with its header for Ethernet, its payload only for raw IP. `l4` counts transport payload.
    """
    data = np.concatenate([data, np.zeros(64, dtype=np.uint8)])
    last = len(data) - 1

    def byte(at: np.ndarray) -> np.ndarray:
        return data[np.minimum(at, last)].astype(np.int64)

    def word(at: np.ndarray) -> np.ndarray:
        return byte(at) << 8 | byte(at + 1)

    offset, captured, link = (np.asarray(a, dtype=np.int64) for a in (offset, captured, link))
    end = offset + captured
    is_raw = np.isin(link, RAW_IP)
    network = offset.copy()
    is_ip = is_raw.copy()

    ethernet = link == ETHERNET
    kind_at = offset + 12
    tagged = np.zeros(len(offset), dtype=bool)
    for _ in range(2):
        tag = ethernet & np.isin(word(kind_at), VLAN_TYPES)
        kind_at = np.where(tag, kind_at + 4, kind_at)
        tagged |= tag
    network = np.where(ethernet, kind_at + 2, network)
    is_ip |= ethernet & (word(kind_at) == ETHERTYPE_IPV4)

    cooked = link == COOKED
    network = np.where(cooked, offset + 16, network)
    is_ip |= cooked & (word(offset + 14) == ETHERTYPE_IPV4)
    cooked2 = link == COOKED_V2
    network = np.where(cooked2, offset + 20, network)
    is_ip |= cooked2 & (word(offset) == ETHERTYPE_IPV4)
    loop = np.isin(link, LOOPBACK)
    network = np.where(loop, offset + 4, network)
    is_ip |= loop

    keep = np.flatnonzero(is_ip & (network + 20 <= end) & (byte(network) >> 4 == 4))
    network, end, tagged, is_raw = network[keep], end[keep], tagged[keep], is_raw[keep]
    header = (byte(network) & 15) * 4
    transport = network + header
    protocol = byte(network + 9)
    first_fragment = (word(network + 6) & 0x1FFF) == 0
    total = word(network + 2)
    # A total length of 0 is what segmentation offload leaves behind.
    packet_end = np.where(total > 0, np.minimum(network + total, end), end)

    tcp = (protocol == TCP) & first_fragment & (transport + 20 <= end)
    udp = (protocol == UDP) & first_fragment & (transport + 8 <= end)
    icmp = (protocol == ICMP) & first_fragment
    has_ports = tcp | udp
    src_port = np.where(has_ports, word(transport), 0)
    dst_port = np.where(has_ports, word(transport + 2), 0)
    flags = np.where(tcp, byte(transport + 13) & 63, 0)
    tcp_header = (byte(transport + 12) >> 4) * 4
    length = np.where(tcp, tcp_header, np.where(udp | icmp, 8, 0))
    body = np.maximum(packet_end - transport - length, 0)

    on_udp = np.isin(src_port, DNS_UDP_PORTS) | np.isin(dst_port, DNS_UDP_PORTS)
    on_tcp = np.isin(src_port, DNS_TCP_PORTS) | np.isin(dst_port, DNS_TCP_PORTS)
    dns = (body > 0) & ((udp & on_udp) | (tcp & on_tcp))
    label = np.select(
        [dns, tcp, udp, icmp], ["DNS", "TCP", "UDP", "ICMP"], default="OTHER"
    ).astype(object)

    if payload_mode == "l4":
        payload = body
    else:
        payload = np.where(
            is_raw,
            np.maximum(end - transport - length, 0),
            np.where(tagged, end - network, np.maximum(end - transport, 0)),
        )

    def address(at: np.ndarray) -> list[str]:
        parts = [byte(at + i) for i in range(4)]
        packed = parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]
        values, inverse = np.unique(packed, return_inverse=True)
        texts = np.array(
            [f"{v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}" for v in values.tolist()],
            dtype=object,
        )
        return texts[inverse] if len(values) else []

    names = _flag_table()
    return pd.DataFrame(
        {
            "row": keep,
            "src_ip": address(network + 12),
            "dst_ip": address(network + 16),
            "src_port": src_port.astype(np.int32),
            "dst_port": dst_port.astype(np.int32),
            "protocol": label,
            "size": captured[keep].astype(np.int32),
            "tcp_flags": [names[f] for f in flags.tolist()],
            "payload_size": payload.astype(np.int32),
        }
    )


def decode_frames(frames: DataFrame, payload_mode: str = "reference") -> DataFrame:
    """Packets from a table (capture_id, seq, ts_us, link, frame BINARY), in batches of bounded size."""
    adopt(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["frame"].map(len).to_numpy(dtype=np.int64)
            data = np.frombuffer(b"".join(pdf["frame"]), dtype=np.uint8)
            starts = np.cumsum(lengths) - lengths
            out = decode(data, starts, lengths, pdf["link"].to_numpy(), payload_mode)
            picked = pdf.iloc[out.pop("row").to_numpy()].reset_index(drop=True)
            out = out.assign(
                capture_id=picked["capture_id"], seq=picked["seq"], ts_us=picked["ts_us"]
            )
            yield out[PACKET_SCHEMA.fieldNames()]

    return frames.select("capture_id", "seq", "ts_us", "link", "frame").mapInPandas(
        run, PACKET_SCHEMA
    )
