"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id. With
suffixes in the order of their text, the suffix nearest before and the one nearest behind that start in a
smaller document (PSV, NSV) share the most with it of all suffixes of smaller documents; the longer of what
they share is its longest previous factor (LPF). Windows whose LPF is `length` are removed, later copies while
the first stays. Only whether LPF reaches `length` matters, so suffixes are ordered by their first `length` bytes.

The corpus is not put into one suffix array. Every window of `length` bytes has a minimizer, the smallest
hash of its `K`-byte strings; windows in a row with the same minimizer form a stretch. Equal windows have
equal minimizers, so suffixes need to be ordered only among stretches of one minimizer:

1. Each text block asks which of its minimizers are also in other documents (sorted 64-bit keys, each with its
   number of stretches).
2. It sends the stretches of these to the minimizer's task, each distinct stretch once, with the smallest
   document that has it. There, equal stretches are merged, and the windows of different stretches are put
   in suffix order. The answer says which windows have an earlier copy.
3. The block removes what these windows cover.

A passage in a third of all documents is sent once per block and merged before suffixes are ordered. A minimizer
with `HOT_STRETCHES` or more, as a phrase among ever different words has, is hot: its windows are sent one by one
and dealt by their own hash, by which equal windows still meet, so no task gets all of one phrase.

Equality of strings is decided by bytes in suffix order; that two windows differ, and that two whole
stretches are equal, by 64-bit hashes. Defined results: null texts are empty; documents with a null id
lose nothing and count for nobody; rows of the same id don't affect each other; texts shorter than `length`
stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirelens.llm.blocks import by_block, by_part, part_of, planes, rows_of, text_blocks, values_of
from wirelens.llm.common import ragged, text_of
from wirelens.llm.order_minhash import BASE, mix
from wirelens.session import scratch_table

K = 24
#: Windows whose hashes are made at a time; places in such a slice fit 24 bits.
SLICE = 1 << 19
#: Keys that one task compares, and bytes of text in a block.
TASK_KEYS = 500_000
BLOCK_BYTES = 2 << 20
#: From so many stretches on, a minimizer's windows are dealt one by one.
HOT_STRETCHES = 20_000


def _hashes(buffer: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the strings of each size at all places, from those of powers of two."""
    powers, length, now = {}, 1, buffer.astype(np.uint64) + np.uint64(1)
    while length <= max(sizes):
        powers[length] = now
        if len(now) <= length:
            break
        now = now[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + now[length:]
        length *= 2
    out = []
    for size in sizes:
        n = max(0, len(buffer) - size + 1)
        whole, have = np.zeros(n, np.uint64), 0
        for length in sorted(powers, reverse=True):
            if size & length and n:
                whole = whole * np.uint64(pow(BASE, length, 1 << 64)) + powers[length][have : have + n]
                have += length
        out.append(mix(whole))
    return out


class Stretches:
    """All stretches of the texts in a buffer.

    first: place of the first window; count: windows; key: hash of the minimizer; name: hash of the whole
    stretch; doc: number of the text.
    """

    def __init__(self, buffer: np.ndarray, sizes: np.ndarray, length: int):
        self.length = length
        ends = np.cumsum(sizes)
        found = [self._slice(buffer, ends, at, length) for at in range(0, max(1, len(buffer)), SLICE)]
        self.first, self.count, self.key, self.name = (np.concatenate(x) for x in zip(*found))
        self.doc = np.searchsorted(ends, self.first, side="right")

    @staticmethod
    def _slice(buffer: np.ndarray, ends: np.ndarray, at: int, length: int) -> tuple[np.ndarray, ...]:
        part = buffer[at : at + SLICE + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        k = min(K, length)
        small, whole = _hashes(part, (k, length))
        # The smallest hash, of equal ones the first: hash above, place below.
        low = (small >> np.uint64(24) << np.uint64(24)) | np.arange(len(small), dtype=np.uint64)
        span, have = length - k + 1, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[:n], low[span - have : span - have + n])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        inside = np.ones(n, bool)  # windows that lie in one text
        for end in ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + len(part), side="left")]:
            inside[max(0, end - at - length + 1) : end - at] = False
        starts = np.ones(n, bool)
        starts[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        starts &= inside
        first = np.flatnonzero(starts)
        bounds = np.ones(n + 1, bool)
        bounds[:n] = starts | ~inside
        stops = np.flatnonzero(bounds)
        count = stops[np.searchsorted(stops, first, side="right")] - first
        ahead = (place[first] - first).astype(np.uint64)
        name = mix(whole[first] * np.uint64(BASE) + whole[first + count - 1]) ^ mix(ahead << np.uint64(32) | count.astype(np.uint64))
        return first + at, count, small[place[first]], name


class Block:
    """A block's texts and stretches, and what it asks and sends."""

    def __init__(self, data: bytes, parts: int, length: int):
        self.rows, self.parts, self.length = rows_of(data), parts, length
        texts = self.rows.column("text").combine_chunks().cast(pa.binary())
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        raw = texts.buffers()[2]
        self.sizes = np.diff(ends)
        self.buffer = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.zeros(0, np.uint8)
        ids = self.rows.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.all = Stretches(self.buffer, self.sizes, length)
        counted = self.known[self.all.doc]
        for field in ("first", "count", "key", "name", "doc"):
            setattr(self.all, field, getattr(self.all, field)[counted])
        self.keys, self.key_of = np.unique(self.all.key, return_inverse=True)
        self.order, self.there, self.cuts = by_part(self.keys, parts)

    def asked(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, keys, whether several documents of this block have the key, its distinct stretches up to 255)."""
        ids = self.ids[self.all.doc]
        least = np.full(len(self.keys), np.iinfo(np.int64).max)
        most = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(least, self.key_of, ids)
        np.maximum.at(most, self.key_of, ids)
        several = least != most
        by_name = np.lexsort((self.all.name, self.key_of))
        names, owners = self.all.name[by_name], self.key_of[by_name]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (owners[1:] != owners[:-1])
        stretches = np.minimum(np.bincount(owners[new], minlength=len(self.keys)), 255).astype(np.uint8)
        return [
            (int(part), self.keys[self.order[a:b]], several[self.order[a:b]], stretches[self.order[a:b]])
            for part, a, b in zip(self.there, self.cuts, self.cuts[1:])
        ]

    def _split(self, hot: np.ndarray) -> np.ndarray:
        """Stretches of hot keys become one stretch for each window, dealt by the window; gives the new ones."""
        old, at = self.all, np.flatnonzero(hot[self.key_of])
        place = np.sort(ragged(old.first[at], old.count[at]))
        hashes = np.empty(len(place), np.uint64)
        for start in range(0, len(self.buffer), SLICE):
            a, b = np.searchsorted(place, [start, start + SLICE])
            if b > a:
                whole = _hashes(self.buffer[start : start + SLICE + self.length - 1], (self.length,))[0]
                hashes[a:b] = whole[place[a:b] - start]
        ends = np.cumsum(self.sizes)
        stay = ~hot[self.key_of]
        old.first = np.concatenate([old.first[stay], place])
        old.count = np.concatenate([old.count[stay], np.ones(len(place), np.int64)])
        old.key = np.concatenate([old.key[stay], hashes])
        old.name = np.concatenate([old.name[stay], mix(hashes)])
        old.doc = np.concatenate([old.doc[stay], np.searchsorted(ends, place, side="right")])
        return np.arange(int(stay.sum()), len(old.first))

    def sent(self, shared: dict[int, tuple[bytes, bytes]]) -> list[tuple[int, np.ndarray]]:
        """(part, stretches): those whose key others have too, each distinct one by its smallest document."""
        elsewhere, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for part, a, b in zip(self.there, self.cuts, self.cuts[1:]):
            for out, bits in zip((elsewhere, hot), shared[int(part)]):
                if bits:
                    out[self.order[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        single = self._split(hot) if hot.any() else np.zeros(0, np.int64)
        if len(single):
            stay = elsewhere[self.key_of[~hot[self.key_of]]]
            mine = np.concatenate([np.flatnonzero(stay), single])
        else:
            mine = np.flatnonzero(elsewhere[self.key_of])
        ids = self.ids[self.all.doc[mine]]
        order = np.lexsort((ids, self.all.name[mine]))
        mine, ids = mine[order], ids[order]
        names = self.all.name[mine]
        head = np.diff(names, prepend=names[:1] + np.uint64(1)) != 0
        self.same = mine, np.cumsum(head) - 1  # every such stretch and its distinct one
        lead = mine[head]
        self.later = ids > ids[head][self.same[1]] if len(mine) else np.zeros(0, bool)
        self.lead = lead
        part = part_of(self.all.key[lead], self.parts)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        return [(int(part[order[a]]), order[a:b]) for a, b in zip(cuts, cuts[1:])]

    def removed(self, shared: dict[int, tuple[bytes, bytes]], answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the buffer go."""
        sent = self.sent(shared)
        masks = np.zeros(len(self.lead), np.uint64)
        for part, which in sent:
            masks[which] = values_of(answers[part], np.uint64)
        mine, lead = self.same
        first, count = self.all.first[mine], self.all.count[mine]
        mask = np.where(self.later, np.uint64(2**64 - 1), masks[lead])
        some = mask != 0
        first, count, mask = first[some], count[some], mask[some]
        within = ragged(np.zeros(len(count), np.int64), count)
        hit = np.repeat(mask, count) >> within.astype(np.uint64) & np.uint64(1) == 1
        starts = ragged(first, count)[hit]
        change = np.zeros(len(self.buffer) + 1, np.int16)
        change[starts] += 1  # a window is in one stretch, so no start comes twice
        change[starts + self.length] -= 1
        return np.cumsum(change[:-1], dtype=np.int16) > 0


def shared_keys(rows: list[tuple[np.ndarray, ...]], hot: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block's sorted keys: which other blocks, or several of its documents, have too; which are hot."""
    keys, several, stretches = (np.concatenate([row[k] for row in rows]) for k in range(3))
    order = np.argsort(keys)
    heads = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] + np.uint64(1)))
    counts = np.diff(np.append(heads, len(keys)))
    some = np.logical_or.reduceat(several[order], heads) | (counts > 1)
    many = np.add.reduceat(stretches[order].astype(np.int64), heads) >= (hot or HOT_STRETCHES)
    out = []
    for found in (some, some & many):
        each = np.zeros(len(keys), bool)
        each[order] = np.repeat(found, counts)
        out.append(np.split(each, np.cumsum([len(k) for k, *_ in rows])[:-1]))
    return out[0], out[1]


def earlier_windows(buffer: np.ndarray, counts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For stretches one after the other in `buffer`: bits of the windows that a smaller document has too."""
    sizes = counts + (length - 1)
    first = np.cumsum(sizes) - sizes
    whole = np.concatenate(
        [_hashes(buffer[at : at + SLICE + length - 1], (length,))[0] for at in range(0, len(buffer) - length + 1, SLICE)]
    )
    last = first + counts - 1
    names = mix(whole[first] * np.uint64(BASE) + whole[last]) ^ mix(counts.astype(np.uint64))
    order = np.lexsort((docs, names))
    head = np.diff(names[order], prepend=names[order[:1]] + np.uint64(1)) != 0
    distinct = order[head]  # of equal stretches, one of the smallest document
    one_of = np.empty(len(order), np.int64)
    one_of[order] = np.cumsum(head) - 1

    # Windows of different stretches; those whose hash nobody else has need no place in suffix order.
    place = ragged(first[distinct], counts[distinct])
    owner = np.repeat(np.arange(len(distinct)), counts[distinct])
    hashes = whole[place]
    by_hash = np.argsort(hashes)
    same = hashes[by_hash][1:] == hashes[by_hash][:-1]
    twice = np.zeros(len(place), bool)
    twice[by_hash[1:][same]] = True
    twice[by_hash[:-1][same]] = True
    place, owner = place[twice], owner[twice]
    doc = docs[distinct][owner]
    masks = np.zeros(len(distinct), np.uint64)
    if len(place):
        earlier = previous_factors(buffer, place, doc, length) >= length
        inside = (place - first[distinct][owner]).astype(np.uint64)
        np.bitwise_or.at(masks, owner[earlier], np.uint64(1) << inside[earlier])
    out = masks[one_of]
    out[docs > docs[distinct][one_of]] = np.uint64(2**64 - 1)
    return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before with a smaller value, -1 for none.

    All values between a place and its candidate are no smaller; where the candidate isn't smaller either,
    its own candidate is the next one. Candidates of candidates double the steps.
    """
    before = np.arange(len(values)) - 1
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[values[before[open_]] >= values[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def previous_factors(buffer: np.ndarray, place: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """LPF of the suffixes at `place`, up to `length`: the longest string that a smaller document has too.

    Suffixes stand in the order of their first `length` bytes, compared as big-endian words.
    """
    words = -(-length // 8)
    texts = np.zeros((len(place), 8 * words), np.uint8)
    texts[:, :length] = np.lib.stride_tricks.sliding_window_view(buffer, length)[place]
    columns = texts.view(">u8").astype(np.uint64)
    order = np.lexsort([columns[:, i] for i in range(words - 1, -1, -1)])
    texts, doc = texts[order, :length], doc[order]
    last = len(order) - 1
    previous, following = nearest_smaller(doc), last - nearest_smaller(doc[::-1])[::-1]
    factors = np.zeros(len(order), np.int64)
    for other, there in ((previous, previous >= 0), (following, following <= last)):
        for first in range(0, len(order), SLICE):  # what is held at a time
            at = first + np.flatnonzero(there[first : first + SLICE])
            differ = texts[at] != texts[other[at]]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
            factors[at] = np.maximum(factors[at], common)
    out = np.empty(len(order), np.int64)
    out[order] = factors
    return out


def _asking(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                asked = Block(data.as_py(), parts, length).asked()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, *_ in asked], pa.int32()),
                        pa.array([block] * len(asked), pa.int64()),
                        pa.array([planes(k) for _, k, _, _ in asked], pa.binary()),
                        pa.array([np.packbits(s).tobytes() for _, _, s, _ in asked], pa.binary()),
                        # Mostly one stretch for every key, which needs no bytes.
                        pa.array([b"" if (n == 1).all() else n.tobytes() for *_, n in asked], pa.binary()),
                    ],
                    names=["part", "block", "keys", "several", "stretches"],
                )

    asked = blocks.mapInArrow(run, "part int, block long, keys binary, several binary, stretches binary")

    def answer(table: pa.Table) -> pa.Table:
        rows = []
        for raw, bits, n in zip(*(table.column(c).to_pylist() for c in ("keys", "several", "stretches"))):
            keys = values_of(raw, np.uint64)
            several = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys)).astype(bool)
            rows.append((keys, several, np.frombuffer(n, np.uint8) if n else np.ones(len(keys), np.uint8)))
        shared, hot = shared_keys(rows, hot_stretches)
        columns = {
            "block": table.column("block"),
            "part": table.column("part"),
            "bits": pa.array([np.packbits(s).tobytes() for s in shared], pa.binary()),
            "hot": pa.array([np.packbits(h).tobytes() if h.any() else b"" for h in hot], pa.binary()),
        }
        return pa.table(columns)

    hot_stretches = HOT_STRETCHES
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, bits binary, hot binary")


def _answering(blocks: DataFrame, shared: DataFrame, parts: int, length: int) -> DataFrame:
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist()):
            texts = Block(data, parts, length)
            parts_of, bits, hot = (right.column(c).to_pylist() for c in ("part", "bits", "hot"))
            bits = dict(zip(parts_of, zip(bits, hot)))
            for part, which in texts.sent(bits):
                lead = texts.lead[which]
                count = texts.all.count[lead]
                strings = texts.buffer[ragged(texts.all.first[lead], count + (length - 1))]
                rows.append((part, block, planes(texts.ids[texts.all.doc[lead]]), planes(count.astype(np.uint8)), strings.tobytes()))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["part", "block", "docs", "counts", "strings"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    sent = by_block(blocks, shared).applyInArrow(send, "part int, block long, docs binary, counts binary, strings binary")

    def answer(table: pa.Table) -> pa.Table:
        counts = [values_of(c, np.uint8).astype(np.int64) for c in table.column("counts").to_pylist()]
        docs = np.concatenate([values_of(d, np.int64) for d in table.column("docs").to_pylist()])
        buffer = np.frombuffer(b"".join(table.column("strings").to_pylist()), np.uint8)
        masks = earlier_windows(buffer, np.concatenate(counts), docs, length)
        cut = np.split(masks, np.cumsum([len(c) for c in counts])[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "part": table.column("part"),
                "masks": pa.array([planes(m) for m in cut], pa.binary()),
            }
        )

    return sent.groupBy("part").applyInArrow(answer, "block long, part int, masks binary")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, whole_characters: bool = False
) -> DataFrame:
    """(row, doc_id, n_bytes, starts, ends, kept): spans of removed bytes and the bytes that stay.

    `row` is a struct of all columns of `docs` but the text. With `whole_characters`, a character goes
    only if all its bytes do, so that what stays is text. `length` is at most 50 + `K`.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        text_of(text).alias("text"),
    )
    blocks, total = text_blocks(rows, size=BLOCK_BYTES)
    parts = max(16, total // 13 // TASK_KEYS)
    shared = scratch_table(_asking(blocks, parts, length), "repeats-shared")
    masks = _answering(blocks, shared, parts, length)
    nothing = F.lit(None).cast("binary")
    answers = shared.select("block", "part", "bits", "hot", nothing.alias("masks")).union(
        masks.select("block", "part", nothing.alias("bits"), nothing.alias("hot"), "masks")
    )

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        parts_of, bits, hot, found = (right.column(c).to_pylist() for c in ("part", "bits", "hot", "masks"))
        shared_bits = {p: (b, h) for p, b, h in zip(parts_of, bits, hot) if b is not None}
        window_masks = {p: m for p, m in zip(parts_of, found) if m is not None}
        out = []
        for data in left.column("data").to_pylist():
            block = Block(data, parts, length)
            gone = block.removed(shared_bits, window_masks)
            out.append(_kept(block, gone, whole_characters))
        return pa.concat_tables(out)

    schema = StructType([rows.schema["row"], *StructType.fromDDL("doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")])
    return by_block(blocks, answers).applyInArrow(apply, schema)


def _whole(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans without the characters that lie in them only in part, and the bytes they cover."""
    padded = np.append(buffer, np.uint8(0))
    for _ in range(3):  # a character has up to three bytes after its first
        first = first + ((padded[first] & 0xC0 == 0x80) & (first < last))
        last = last - ((padded[last] & 0xC0 == 0x80) & (first < last))
    first, last = first[first < last], last[first < last]
    change = np.zeros(len(buffer) + 1, np.int8)
    change[first] += 1
    np.subtract.at(change, last, 1)
    return first, last, np.cumsum(change[:-1], dtype=np.int8) > 0


def _kept(block: Block, gone: np.ndarray, whole_characters: bool) -> pa.Table:
    ends = np.cumsum(block.sizes)
    starts = ends - block.sizes
    edge = np.zeros(len(gone) + 1, bool)
    edge[ends[ends < len(gone)]] = True
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:-1]
    finish = gone.copy()
    finish[:-1] &= ~gone[1:] | edge[1:-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    if whole_characters:
        first, last, gone = _whole(block.buffer, first, last)
    of_doc = np.searchsorted(ends, first, side="right")
    cuts = np.searchsorted(of_doc, np.arange(len(ends) + 1)).astype(np.int32)
    lost = np.bincount(of_doc, last - first, len(ends)).astype(np.int64)
    stays = np.concatenate([[0], np.cumsum(block.sizes - lost)]).astype(np.int32)
    kept = block.buffer[~gone]

    def spans(places: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(places - starts[of_doc]))

    return pa.table(
        {
            "row": block.rows.column("row"),
            "doc_id": block.rows.column("doc_id"),
            "n_bytes": pa.array(block.sizes.astype(np.int64)),
            "starts": spans(first),
            "ends": spans(last),
            "kept": pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(stays), pa.py_buffer(kept)]),
        }
    )
