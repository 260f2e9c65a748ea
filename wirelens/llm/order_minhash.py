"""Order MinHash fingerprints: likeness by edit distance.

A text's k-mers of code points are numbered by occurrence, so that each (k-mer, number) is unique, and
hashed to places on a circle. Each of `size` equally spaced points of the circle selects the `tuple_size`
k-mers that follow it (one permutation serves all points). Their text order is kept: the component is a
hash of the selected k-mers in the order in which they stand in the text. The likeness of two texts is
the share of equal components. Moving text around changes the order and so the components, which plain
MinHash doesn't see.

Defined results: a text shorter than `k` is one k-mer; a null or empty text has a fingerprint of zeros,
which no other text has; equal texts have equal fingerprints. The fingerprint is `4 * size` hex digits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import chunks, text_of
from wirelens.session import scratch_table

K = 12
SIZE = 64
TUPLE = 2

# An odd multiplier for polynomial hashes, and the finaliser of splitmix64.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Places are the upper 40 bits of a sort key; positions in the text the lower 24.
PLACE_BITS, POSITION_BITS = 40, 24


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of `k` values, put together from runs of powers of two."""
    hashes, length = values.astype(np.uint64) + np.uint64(1), 1
    whole, have = None, 0
    left = k
    while True:
        if left & 1:
            if whole is None:
                whole, have = hashes, length
            else:
                n = len(hashes) - have
                whole = whole[:n] * np.uint64(pow(BASE, length, 1 << 64)) + hashes[have:]
                have += length
        left >>= 1
        if not left:
            return mix(whole)
        hashes = hashes[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + hashes[length:]
        length *= 2


class OrderMinHash:
    """Fingerprints of single texts, as arrays of `size` 16-bit components."""

    def __init__(self, k: int = K, size: int = SIZE, tuple_size: int = TUPLE):
        self.k, self.size, self.tuple_size = k, size, tuple_size
        self.points = (np.arange(size, dtype=np.uint64) << np.uint64(PLACE_BITS)) // np.uint64(size)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(self.size, np.uint16)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        places = window_hashes(points, min(self.k, len(points))) >> np.uint64(64 - PLACE_BITS)
        n = len(places)
        if n < 1 << POSITION_BITS:
            places, positions = self._numbered_short(places)
        else:
            places, positions = self._numbered_long(places)
        width = min(self.tuple_size, n)
        taken = (np.searchsorted(places, self.points)[:, None] + np.arange(width)) % n
        chosen, where = places[taken], positions[taken]
        chosen = np.take_along_axis(chosen, np.argsort(where, axis=1), axis=1)
        code = np.full(self.size, n if n < width else 0, np.uint64)
        for column in range(width):
            code = mix(code * np.uint64(BASE) + chosen[:, column] + np.uint64(1))
        return np.maximum(code >> np.uint64(48), 1).astype(np.uint16)

    def _numbered_short(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places and their positions; a key of both sorts them at once."""
        low = np.uint64((1 << POSITION_BITS) - 1)
        keys = np.sort(places << np.uint64(POSITION_BITS) | np.arange(len(places), dtype=np.uint64))
        sorted_places = keys >> np.uint64(POSITION_BITS)
        moved, again = _occurrences(sorted_places)
        if len(moved):
            keys[moved] = again << np.uint64(POSITION_BITS) | keys[moved] & low
            keys.sort()
        return keys >> np.uint64(POSITION_BITS), (keys & low).astype(np.int64)

    def _numbered_long(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(places, kind="stable")
        places = places[order]
        moved, again = _occurrences(places)
        places[moved] = again
        rank = np.lexsort((order, places))
        return places[rank], order[rank]


def _occurrences(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted places (equal ones in text order): which are not a first occurrence, and their own places."""
    repeated = np.flatnonzero(places[1:] == places[:-1]) + 1
    if not len(repeated):
        return repeated, places[:0]
    first = np.ones(len(repeated), bool)
    first[1:] = repeated[1:] != repeated[:-1] + 1
    heads = np.flatnonzero(first)
    run = np.arange(len(repeated)) - np.repeat(heads, np.diff(np.append(heads, len(repeated)))) + 1
    again = mix(places[repeated] * np.uint64(BASE) + run.astype(np.uint64))
    return repeated, again >> np.uint64(64 - PLACE_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def hexadecimal(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, size: int = SIZE, tuple_size: int = TUPLE
) -> DataFrame:
    """(key, fingerprint) of every document, in one pass without a shuffle."""

    def run(batches):
        sketch = OrderMinHash(k, size, tuple_size)
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([hexadecimal(sketch(t)) for t in texts], pa.string())],
                names=[key, "fingerprint"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, fingerprint string")


def compared(fingerprint: str, other: str, size: int = SIZE) -> float:
    """Likeness of two fingerprints as text."""
    return sum(fingerprint[i : i + 4] == other[i : i + 4] for i in range(0, 4 * size, 4)) / size


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the next text, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, size: int = SIZE, tuple_size: int = TUPLE
) -> DataFrame:
    """Every document's fingerprint next to those of its edited text and of the next document.

    The next document is the one with the next smaller id, after the last one the first (rows of equal
    id follow each other in the order of their texts; null ids come last). Documents are ordered by a
    range partitioning; a task has all next documents but that of its last row. Last and first rows of
    tasks, two for each, are joined afterwards.
    """

    def run(batches):
        sketch = OrderMinHash(k, size, tuple_size)
        part = TaskContext.get().partitionId()
        held = None  # the row that waits for its next one
        for batch, texts in chunks(batches):
            out: list[tuple] = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), texts):
                code = sketch(t)
                if held is None:
                    out.append((part, 0, t, doc, *[None] * 6))
                else:
                    out.append((part, 1, None, held[0], *_compared(sketch, *held[1:], t, code)))
                held = doc, t, code
            yield _rows(out)
        if held is not None:
            yield _rows([(part, 2, held[1], held[0], *[None] * 6)])

    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
        .repartitionByRange(F.col("doc_id").desc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    )
    found = scratch_table(ordered.mapInArrow(run, f"part int, kind int, text string, {_ROW}"), "order-minhash")
    names = [c.split()[0] for c in _ROW.split(", ")]
    inner = found.where("kind = 1").select(*names)

    # Two rows for each task: the window runs over their numbers only, the texts are joined to it.
    ends = found.where("kind != 1")
    heads = ends.where("kind = 0")
    in_order = Window.orderBy("part")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = heads.select(
        "part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(everything)).alias("after")
    )
    pairs = (
        ends.where("kind = 2")
        .select("part", "doc_id", "text")
        .join(links, "part")
        .join(heads.select(F.col("part").alias("after"), F.col("text").alias("following")), "after")
        .select("doc_id", "text", "following")
    )

    def finish(batches):
        sketch = OrderMinHash(k, size, tuple_size)
        for batch in batches:
            out = [
                (doc, *_compared(sketch, t, sketch(t), following, sketch(following)))
                for doc, t, following in zip(*(batch.column(i).to_pylist() for i in range(3)))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), list(_FOUND.types)[3:])], names=names
            )

    return inner.unionByName(pairs.mapInArrow(finish, _ROW))


def _compared(sketch: OrderMinHash, text: str, code: np.ndarray, following: str, next_code: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    edited_code = sketch(edited)
    return (
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        hexadecimal(code),
        hexadecimal(edited_code),
        likeness(code, edited_code),
        likeness(code, next_code),
    )


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)


_FOUND = pa.schema(
    [
        ("part", pa.int32()),
        ("kind", pa.int32()),
        ("text", pa.string()),
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
