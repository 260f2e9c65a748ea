"""Tables of text blocks: rows put together to pieces of a few megabytes, written once.

Operators that ask the whole corpus about parts of a text (is this piece known elsewhere? how often does
this word pair come?) do so a block at a time: a block asks about each distinct part once, as sorted arrays
of 64-bit keys dealt out by key, and gets one array of answers back from each part of the key space. The
rows that Spark shuffles are such arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import chunks
from wirelens.session import measured_table

BLOCK_BYTES = 4 << 20


def text_blocks(rows: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, data) with all columns of `rows` inside, and the bytes of all texts."""

    def put_together(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, have = [], 0

        def block():
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            row = {"block": [part << 32 | seq], "data": [sink.getvalue().to_pybytes()], "bytes": [have]}
            return pa.RecordBatch.from_pydict(row)

        for batch, texts in chunks(batches, text, size // 4):
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema))
            have += sum(map(len, texts))
            if have >= size:
                yield block()
                held, have, seq = [], 0, seq + 1
        if held:
            yield block()

    blocks = rows.mapInArrow(put_together, "block long, data binary, bytes long")
    table, seen = measured_table(blocks, "text-blocks", total=F.sum("bytes"))
    return table.select("block", "data"), seen["total"] or 0


def rows_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: an order by part (and key), the parts there are, and where each begins and the last ends."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    return order, part[order][cuts[:-1]], cuts


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, all first ones before all second ones: sorted values then compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def values_of(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def by_block(blocks: DataFrame, answers: DataFrame):
    """Blocks next to all their answers."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block"))

