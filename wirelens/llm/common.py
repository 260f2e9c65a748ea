"""What several operators of this package share.

Operators read the columns they are told to and return rows of their own, so further columns of the
input can have any name. A null text counts as the empty text.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.session import measured_table, scratch_table

#: Characters of text that a Python worker handles at a time.
CHUNK_CHARS = 1 << 21

#: Bytes of rows that Spark hands to a Python worker at a time; by number of rows alone, long texts fill the memory.
BATCH_BYTES = 4 << 20

WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, from now on handing rows to Python workers in batches of `BATCH_BYTES`."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != f"{BATCH_BYTES}b":
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return spark


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def chunks(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches of about `size` bytes of text each, with the texts as strings."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        first, n = 0, batch.num_rows
        while first < n:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            part = batch.slice(first, last - first)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            first = last


def sampled(df: DataFrame, n: int, rows: int, *by: str) -> DataFrame:
    """About `rows` of the `n` rows of `df` (all, if there are no more): those of smallest hash.

    A filter, so that tasks send no more to the driver than is kept.
    """
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < F.lit(int(rows / n * (1 << 40))))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, … of every run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def per_worker(kind: str, settings: tuple, make: Callable):
    """What `make` gives, once in each Python worker, which serves many tasks; the latest of each kind.

    Functions come to workers by value, with globals of their own, so what is to last is kept in `sys`.
    """
    held = sys.modules.setdefault("wirelens-held-by-worker", types.ModuleType("held")).__dict__
    if (held.get(kind) or (None,))[0] != settings:
        held[kind] = None  # the old one goes first
        held[kind] = settings, make()
    return held[kind][1]


class PieceCoder:
    """Ids of text pieces, remembered per piece. `resolve` gives the id lists of new pieces, or all their ids and
    each piece's number of ids.

    Pieces are what `first` cuts a text into, or else the words between single spaces, a text's first word with
    `mark` in front.

    A piece that `resolve` answers with None (a number of -1) can't stand alone: `split` then gives other pieces
    for the texts that hold it. At most `limit` pieces are remembered between two calls; then it starts anew.
    """

    def __init__(
        self,
        resolve: Callable[[list[str]], list | tuple[np.ndarray, np.ndarray]],
        first: Callable[[str], list[str]] | None = None,
        split: Callable[[str], list[str]] | None = None,
        limit: int = 600_000,
        mark: str = "",
    ):
        self.resolve, self.first, self.split, self.limit, self.mark = resolve, first, split, limit, mark
        self._forget()

    def _forget(self) -> None:
        new: list[str] = []

        class Codes(dict):
            def __missing__(self, piece):
                self[piece] = code = len(self)
                new.append(piece)
                return code

        self.codes, self.new = Codes(), new
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 15, np.int64)
        self.lengths = np.zeros(1 << 15, np.int64)  # -1: can't stand alone

    def _learn(self) -> None:
        known = len(self.codes) - len(self.new)
        found = self.resolve(self.new)
        if isinstance(found, list):
            lengths = np.fromiter((-1 if one is None else len(one) for one in found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(one or () for one in found), np.uint32, int(lengths[lengths > 0].sum()))
        else:
            ids, lengths = found
        sizes = np.maximum(lengths, 0)
        total = self.used + len(ids)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.codes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : total] = ids
        self.starts[known : len(self.codes)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[known : len(self.codes)] = lengths
        self.used = total
        self.new.clear()

    def _codes(self, pieces: Iterable[str], n: int) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, n)
        if self.new:
            self._learn()
        return codes

    def _coded(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return self._codes(chain.from_iterable(pieces), int(counts.sum())), counts

    def _coded_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for the words between spaces; Arrow tells equal words of all texts apart from others."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parted = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words, ends = parted.flatten(), parted.offsets.to_numpy()
        counts = np.diff(ends)
        told = words.dictionary_encode()
        whole = pa.ListArray.from_arrays([0, len(told.dictionary)], told.dictionary)
        known = pc.binary_join(whole, " ")[0].as_py().split(" ")  # much faster than one by one
        codes = self._codes(known, len(known))[told.indices.to_numpy()]
        if self.mark:
            firsts = words.take(pa.array(ends[:-1])).to_pylist()
            codes[ends[:-1]] = self._codes((self.mark + word for word in firsts), len(firsts))
        return codes, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and the number of ids of each text."""
        if len(self.codes) > self.limit:
            self._forget()
        codes, counts = self._coded([self.first(t) for t in texts]) if self.first else self._coded_words(texts)
        lengths = self.lengths[codes]
        if self.split and (lengths < 0).any():
            ends = np.cumsum(counts)
            parts = np.split(codes, ends[:-1])
            again = np.unique(np.searchsorted(ends, np.flatnonzero(lengths < 0), side="right"))
            found, sizes = self._coded([self.split(texts[i]) for i in again])
            for i, part in zip(again, np.split(found, np.cumsum(sizes)[:-1])):
                parts[i], counts[i] = part, len(part)
            codes = np.concatenate(parts)
            lengths = self.lengths[codes]
        ids = self.flat[ragged(self.starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.concatenate([[0], counts]))]
        return ids, np.diff(ends)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected edges (a, b) of longs: the smallest node reachable.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows. A round is two grouped minima and two joins; hub nodes meet their minimum by a join
    whose large partitions Spark splits. Rounds go on until the edges stay the same; each is written to
    the shared folder. No nodes or edges come to the driver.
    """

    def starred(pairs: DataFrame, larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(low, "u").withColumn("m", F.least("u", "m"))
        if larger:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(
                F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
            ).select("e.*")
        return out.where("u != v").distinct()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        table, seen = measured_table(df, "stars", total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        return table, (seen["n"], seen["total"])

    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, mark = written(ordered.distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now, after = written(starred(scratch_table(starred(both, True), "stars"), False))
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
