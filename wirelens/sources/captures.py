"""Capture files (pcap and pcapng) to packets.

Records of a capture are chained, so a file cannot be entered in the middle. A first job hops over
the record headers and notes where each part of a file starts; a second one decodes the parts, so
that one large file is read by many tasks. `spark.read.format("capture")` reads one file per task.
"""

from __future__ import annotations

import json
import os
import struct
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelens.schemas import PACKETS
from wirelens.sources.frames import decode

# Fixed values of the two file formats.
PCAP_MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, ENHANCED, SIMPLE = 0x0A0D0D0A, 1, 6, 3
EXTENSIONS = (".pcap", ".pcapng")
PART_BYTES = 64 << 20
PARTS = (
    "capture_id string, path string, part_start bigint, part_end bigint, first_seq bigint, "
    "state string"
)


class Record(NamedTuple):
    at: int  # start of the record in the file
    data_at: int
    captured: int
    ts_us: int
    link: int


class Capture:
    """Hops over the records of an open capture; `state` is what decoding from here on needs."""

    def __init__(self, file, state: dict | None = None):
        self.file = file
        self.state = state or self._read_header()

    def _read_header(self) -> dict:
        magic = self.file.read(4)
        if magic in PCAP_MAGICS:
            order, per_us = PCAP_MAGICS[magic]
            rest = self.file.read(20)
            if len(rest) < 20:
                raise ValueError("truncated header")
            _, _, _, _, snap, link = struct.unpack(order + "HHiIII", rest)
            link, most = link & 0x0FFFFFFF, max(snap, LONGEST_RECORD)
            return {"kind": "pcap", "order": order, "per_us": per_us, "link": link, "most": most, "at": 24}
        if magic == PCAPNG_MAGIC:
            return {"kind": "pcapng", "order": "<", "interfaces": [], "at": 0}
        raise ValueError("not a capture file")

    def records(self, end: int | None = None) -> Iterator[Record]:
        """Records that start before `end`. Stops at a truncated record."""
        hop = self._pcap if self.state["kind"] == "pcap" else self._pcapng
        while end is None or self.state["at"] < end:
            record = hop()
            if record is None:
                return
            if record:
                yield record

    def _pcap(self):
        state = self.state
        self.file.seek(state["at"])
        head = self.file.read(16)
        if len(head) < 16:
            return None
        sec, frac, captured, _ = struct.unpack(state["order"] + "IIII", head)
        if captured > state["most"]:
            raise ValueError("broken record length")
        at = state["at"]
        state["at"] = at + 16 + captured
        ts_us = sec * 1_000_000 + frac // state["per_us"]
        return Record(at, at + 16, captured, ts_us, state["link"])

    def _pcapng(self):
        """A record, False for a block without one, None at the end."""
        state, at = self.state, self.state["at"]
        self.file.seek(at)
        head = self.file.read(12)
        if len(head) < 12:
            return None
        if head[:4] == PCAPNG_MAGIC:
            state["order"] = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            state["interfaces"] = []
        order = state["order"]
        kind, length = struct.unpack(order + "II", head[:8])
        if length < 12 or length % 4:
            raise ValueError("broken block length")
        state["at"] = at + length
        if kind == INTERFACE:
            self.file.seek(at + 8)
            body = self.file.read(length - 12)
            state["interfaces"].append(self._interface(body, order))
        elif kind == ENHANCED:
            self.file.seek(at + 8)
            body = self.file.read(20)
            if len(body) < 20:
                return None
            which, high, low, captured, _ = struct.unpack(order + "IIIII", body)
            if captured > length - 32:
                raise ValueError("broken record length")
            link, units = state["interfaces"][which]
            ts_us = (high << 32 | low) * 1_000_000 // units
            return Record(at, at + 28, captured, ts_us, link)
        elif kind == SIMPLE and state["interfaces"]:
            original = struct.unpack(order + "I", head[8:12])[0]
            return Record(at, at + 12, min(original, length - 16), 0, state["interfaces"][0][0])
        return False

    @staticmethod
    def _interface(body: bytes, order: str) -> tuple[int, int]:
        """Link type, and time units per second (option 9, microseconds by default)."""
        link, units, at = struct.unpack(order + "H", body[:2])[0], 1_000_000, 8
        while at + 4 <= len(body):
            code, size = struct.unpack(order + "HH", body[at : at + 4])
            if code == 0:
                break
            if code == 9 and size:
                value = body[at + 4]
                units = 2 ** (value & 127) if value & 128 else 10**value
            at += 4 + (size + 3) // 4 * 4
        return link, units


def _parts(path: str, part_bytes: int, errors: str) -> list[tuple]:
    """Cut points of a file: (start, end, first sequence number, state at the start)."""
    try:
        with open(path, "rb", buffering=1 << 20) as file:
            capture = Capture(file)
            found, seq, part_end = [], 0, -1
            start_state = json.dumps(capture.state)
            for record in capture.records():
                if record.at >= part_end:
                    if found:
                        found[-1][1] = record.at
                    state = start_state if not found else json.dumps({**capture.state, "at": record.at})
                    found.append([record.at, 1 << 62, seq, state])
                    part_end = record.at + part_bytes
                seq += 1
            if not found:
                raise ValueError("no packets")
            return [tuple(p) for p in found]
    except (ValueError, IndexError, struct.error) as error:
        if errors == "DROP":
            return []
        raise ValueError(f"Not a valid capture: {path}: {error}") from error


BATCH_BYTES = 8 << 20
#: Records may be longer than the header's snapshot length, but not than this.
LONGEST_RECORD = 1 << 18


def _packets(
    capture_id: str, path: str, end: int, seq: int, state: str, payload_mode: str
) -> Iterator[pd.DataFrame]:
    """Packets of one part, in batches of bounded size. `seq` counts all records of the file."""
    with open(path, "rb", buffering=1 << 20) as file:
        capture = Capture(file, json.loads(state))
        batch: list[Record] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal seq
            chunks = []
            for record in batch:
                file.seek(record.data_at)
                chunks.append(file.read(record.captured))
            lengths = np.array([len(c) for c in chunks], dtype=np.int64)
            data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
            links = np.array([r.link for r in batch])
            out = decode(data, np.cumsum(lengths) - lengths, lengths, links, payload_mode)
            row = out.pop("row").to_numpy()
            times = np.array([r.ts_us for r in batch], dtype=np.int64)
            out = out.assign(capture_id=capture_id, seq=seq + row, ts_us=times[row])
            seq += len(batch)
            return out[PACKETS.fieldNames()]

        for record in capture.records(end):
            batch.append(record)
            size += record.captured
            if size >= BATCH_BYTES:
                yield flush()
                batch, size = [], 0
        if batch:
            yield flush()


def list_captures(path: str) -> list[str]:
    """Capture files under a path that driver and executors share."""
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(f"Capture path not found: {path}")
    return sorted(
        os.path.join(folder, name)
        for folder, _, names in os.walk(path)
        for name in names
        if name.lower().endswith(EXTENSIONS)
    )


def read_captures(
    spark: SparkSession,
    path: str,
    *,
    errors: str = "FAILFAST",
    payload_mode: str = "reference",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Packets of every capture under `path`; capture_id is the file's path."""
    files = spark.createDataFrame([(f,) for f in list_captures(path)], "path string")
    tasks = spark.sparkContext.defaultParallelism

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PARTS.split(", ")]
        for pdf in batches:
            for name in pdf["path"]:
                rows = [(name, name, *part) for part in _parts(name, part_bytes, errors)]
                yield pd.DataFrame(rows, columns=columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                yield from _packets(
                    p.capture_id, p.path, p.part_end, p.first_seq, p.state, payload_mode
                )

    parts = files.repartition(tasks).mapInPandas(cut, PARTS)
    spread = parts.repartition(4 * tasks, F.col("path"), F.col("part_start"))
    return spread.mapInPandas(read, PACKETS)


class CaptureFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.errors = options.get("errors", "FAILFAST")
        self.payload_mode = options.get("payload_mode", "reference")

    def partitions(self) -> list[CaptureFile]:
        return [CaptureFile(path) for path in list_captures(self.path)]

    def read(self, partition: CaptureFile):
        import pyarrow as pa

        parts = _parts(partition.path, 1 << 62, self.errors)
        for _, end, seq, state in parts:
            for pdf in _packets(
                partition.path, partition.path, end, seq, state, self.payload_mode
            ):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)


class CaptureSource(DataSource):
    """`spark.read.format("capture").load(path)` after `spark.dataSource.register(CaptureSource)`."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return PACKETS

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)
