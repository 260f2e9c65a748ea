"""Runs of repeated words by maximal pairs over a tree of LCP intervals.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its first word and the
word q later begin two equal stretches of `length - q` words, which differ in the word behind them and in the
word in front: a maximal pair at distance q. Conversely, a maximal pair whose common length is at least three
times its distance is a run of the length of both together, so runs need no extension. The suffixes of a text
are sorted, and the tree of their LCP intervals is gone through bottom-up. An interval of depth l holds the
places where one stretch of l words occurs, in order, each with the class of the word to its left. When two
intervals come together at depth l, pairs of different left classes and a distance of up to l / 3 are maximal
pairs of exactly l words. Only neighbours can be such a pair: three occurrences so close lie in one run, and
all but its first one have the same word to their left. The smaller interval goes into the larger one.

Suffixes are sorted only where runs can be. In a run of period q, each four words come again after q words at
the latest, for at least 3 (q - 1) places in a row. Other places are left out beforehand, which loses no run.

Every text is handled in its task's stream, without a shuffle; memory grows with the longest text.

Defined results: null and empty texts have no words, hence no runs, and keep the empty text. Repeated rows are
each handled. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import chunks, ragged, text_of

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Words whose recurrence tells where runs can be.
GRAM = 4
#: Places in one piece of an interval's list.
PIECE = 512


class Numbers(dict):
    """A number for each word, by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Places:
    """Places in ascending order, in pieces that are cheap to insert into."""

    def __init__(self, place: int):
        self.pieces, self.lasts, self.size = [[place]], [place], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def insert(self, place: int) -> tuple[int, int]:
        """Put a place in; gives its neighbours, -1 for none."""
        pieces, lasts = self.pieces, self.lasts
        k = bisect_left(lasts, place)
        if k == len(lasts):
            k -= 1
            lasts[k] = place
        piece = pieces[k]
        at = bisect_left(piece, place)
        before = piece[at - 1] if at else pieces[k - 1][-1] if k else -1
        after = piece[at] if at < len(piece) else -1
        piece.insert(at, place)
        self.size += 1
        if len(piece) > 2 * PIECE:
            pieces[k : k + 1] = piece[:PIECE], piece[PIECE:]
            lasts.insert(k, piece[PIECE - 1])
        return before, after


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by their suffix, and the common length with the suffix before (0 for the first).

    Ranks by 1, 2, 4, … words; equal ranks of every length give the common lengths from the longest down.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    levels, width = [rank.astype(np.int32)], 1
    while n and rank.max() < n - 1 and width < n:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        levels.append(rank.astype(np.int32))
        width *= 2
    common = np.zeros(n, np.int64)
    one, other = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(one, other) < n)
        same = inside[levels[level][one[inside]] == levels[level][other[inside]]]
        # Two suffixes of equal rank are equal for the level's width, or to their ends.
        for side in (one, other):
            side[same] += 1 << level
        common[1:][same] += 1 << level
    return order, common


def maximal_pairs(order: np.ndarray, common: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, from suffix order, common lengths and the words to the left."""
    least = min(max(LEAST_LENGTH - q, (LEAST_POWER - 1) * q) for q in range(1, LEAST_LENGTH + 1))
    deep = common >= least
    found: list[tuple[int, int, int]] = []

    def pair(a: int, b: int, depth: int) -> None:
        q = b - a
        if (LEAST_POWER - 1) * q <= depth and depth + q >= LEAST_LENGTH and left[a] != left[b]:
            found.append((a, depth + q, q))

    def merged(one: Places, other: Places, depth: int) -> Places:
        if one.size < other.size:
            one, other = other, one
        places = list(other)
        last = -1
        for place, following in zip(places, [*places[1:], -1]):
            before, after = one.insert(place)
            if before >= 0 and before != last:
                pair(before, place, depth)
            if after >= 0 and not 0 <= following < after:
                pair(place, after, depth)
            last = place
        return one

    starts = np.flatnonzero(~deep & np.append(deep[1:], False))  # a suffix that shares much with the next one only
    ends = np.flatnonzero(deep & np.append(~deep[1:], True)) + 1
    order, common, left = order.tolist(), common.tolist(), left.tolist()
    for first, end in zip(starts.tolist(), ends.tolist()):
        stack: list[tuple[int, Places]] = []
        now = Places(order[first])
        for at in range(first + 1, end):
            depth = common[at]
            while stack and stack[-1][0] > depth:
                inner, before = stack.pop()
                now = merged(before, now, inner)
            stack.append((depth, now))
            now = Places(order[at])
        while stack:
            inner, before = stack.pop()
            now = merged(before, now, inner)
    return found


def regions(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs can be: stretches (first, end) of places, with a word to spare on both sides.

    `words` are numbers, one text after the other; `doc` is every word's text, ascending.
    """
    n = len(words)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < LEAST_LENGTH:
        return nothing
    m = n - GRAM + 1
    key = doc[:m].astype(np.uint64)
    for k in range(GRAM):  # equal words have equal keys; that others might too costs time only
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m].astype(np.uint64)
    inside = np.flatnonzero(doc[:m] == doc[GRAM - 1 :])
    by_key = inside[np.argsort(key[inside], kind="stable")]
    again = key[by_key[1:]] == key[by_key[:-1]]
    far = np.full(m, n, np.int64)  # how soon the same four words come again
    far[by_key[:-1][again]] = np.diff(by_key)[again]
    cuts = np.append(np.flatnonzero(np.diff(doc)) + 1, n)
    covered = np.zeros(n + 1, np.int64)
    farthest = int(far[far < n].max(initial=0))
    reach = 1
    while reach < 2 * farthest:
        near = far <= reach
        q = reach // 2 + 1  # the smallest period that this reach is for
        need = max((LEAST_POWER - 1) * q, LEAST_LENGTH - q) - GRAM + 1
        edges = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
        first, end = edges[::2], edges[1::2]
        long = end - first >= need
        first, end = first[long], end[long]
        end = np.minimum(end + reach + GRAM, cuts[np.searchsorted(cuts, first, side="right")])
        np.add.at(covered, np.maximum(first - 1, 0), 1)
        np.add.at(covered, end, -1)
        reach *= 2
    edges = np.flatnonzero(np.diff((np.cumsum(covered[:-1]) > 0).astype(np.int8), prepend=0, append=0))
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return nothing
    # Stretches end with their text.
    at = np.searchsorted(first, cuts, side="left") - 1
    inner = cuts[(at >= 0) & (cuts < end[at])]
    first, end = np.unique(np.concatenate([first, inner])), np.unique(np.concatenate([end, inner]))
    return first, end


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (place, length, period) of all runs of texts that follow each other, by place and period."""
    first, end = regions(words, doc)
    if not len(first):
        return np.zeros((0, 3), np.int64)
    sizes = end - first
    # A mark of its own in front of every region: no two suffixes are equal beyond one.
    marks = np.cumsum(sizes + 1) - sizes - 1
    places = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
    inner = np.ones(len(places), bool)
    inner[marks] = False
    places[inner] = ragged(first, sizes)
    joined = np.empty(len(places), np.int64)
    joined[inner] = words[places[inner]]
    joined[marks] = int(words.max()) + 1 + np.arange(len(marks))
    order, common = suffix_order(joined)
    left = np.concatenate([[-1], joined[:-1]])
    found = np.array(maximal_pairs(order, common, left), np.int64).reshape(-1, 3)
    found[:, 0] = places[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeat_tail(words: list, doc_id: int | None) -> list:
    """The words with a periodic tail planted in one text of ten, as its id's checksum says."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    rounds = -(-(n - start) // period)
    return words[:start] + (words[start : start + period] * rounds)[: n - start]


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", tails: bool = False) -> DataFrame:
    """(key, n_words, runs, kept) for every row: runs (start, length, period) by start and period, and the words
    that no run repeats, joined by one space.

    A run is at least `LEAST_LENGTH` words and `LEAST_POWER` periods long; its words behind the first period go.
    `tails` plants periodic tails (see `repeat_tail`) before.
    """

    def run(batches):
        for batch, texts in chunks(batches):
            ids = batch.column("key").to_pylist()
            words = [one.encode("utf-8", "surrogatepass").split() for one in texts]
            yield rows(ids, list(map(repeat_tail, words, ids)) if tails else words)

    def rows(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(words)), sizes)
        begin = np.cumsum(sizes) - sizes
        found = runs_of(numbers, doc)
        of_doc = doc[found[:, 0]]
        cuts = np.searchsorted(of_doc, np.arange(len(words) + 1))
        found[:, 0] -= begin[of_doc]
        kept = []
        for i, one in enumerate(words):
            mine = found[cuts[i] : cuts[i + 1]]
            if len(mine):
                gone = np.zeros(len(one) + 1, np.int64)
                np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
                np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
                one = [one[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            kept.append(b" ".join(one).decode("utf-8", "surrogatepass"))
        parts = [pa.array(found[:, k]) for k in range(3)]
        listed = pa.ListArray.from_arrays(
            pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(parts, names=["start", "length", "period"])
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes), listed, pa.array(kept, pa.string())],
            names=[key, "n_words", "runs", "kept"],
        )

    rows_in = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    schema = f"`{key}` long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
    return rows_in.mapInArrow(run, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per text: number of runs, the longest one, and checksums of all runs and of what is kept."""
    longest = F.expr(
        """aggregate(runs, cast(null as struct<start: long, length: long, period: long>),
        (best, r) -> if(best is null or r.length > best.length, r, best))"""
    )
    listed = F.expr("concat_ws('', transform(runs, r -> concat_ws(',', r.start, r.length, concat(r.period, '\\n'))))")
    return found.withColumn("best", longest).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
