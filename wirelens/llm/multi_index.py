"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors has its own codebook; a pair of codewords is a cell of the product grid. Every
vector is stored in its home cell and visits the cells nearest to it, in the order of the summed distances
of both halves (a multi-sequence traversal). How many cells are visited is measured, twice: a bounded set of
query vectors is compared with all vectors, each linked pair counting once, and the same vectors get planted
neighbours, at just the threshold in random directions. The traversal goes on as far as it takes to reach
`target_recall` of both, so rare or loose links are found as well as frequent ones. Vectors that meet in a cell
are verified by their cosine: in single precision, with a bound on its error, and in double precision
where that leaves a doubt.

A vector doesn't travel to every cell that it visits. Cells are put together to regions, products of groups of
codewords, and it is sent once to each region with such a cell, with its reach, the distance of the last
cell that it visits. What is within reach is told in the region, as anywhere else, since coordinates and codewords
are rounded to steps of `STEP` for it, which makes distances exact. Regions are dealt into rounds, so that no
round writes much more than the vectors themselves, and a round's files go when it is over.

Bounds: codebooks are fitted on about `SAMPLE_ROWS` vectors (`CODE_ROWS` for each codeword, if that is more) and
the traversal is measured with `QUERY_ROWS`, both those of smallest hash; all vectors are indexed. Equal vectors of a label are one class with a
number of copies. Regions with many vectors or visitors are dealt into blocks of about `HOST_BYTES` and `GUEST_BYTES`,
and every block of vectors meets every block of visitors. A task gives counts and a spanning forest of links,
never pairs.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components, and those with a null label, link with nothing: 0 links, their own component, kept.
Repeated rows are links of each other. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from wirelens.llm.common import bounded_batches, components, ragged, sampled
from wirelens.session import drop_scratch, measured_table, scratch_table, shuffles_dropped

SAMPLE_ROWS, CODE_ROWS = 8_192, 32
QUERY_ROWS = 1_024
#: Neighbours planted next to each query vector.
PLANTED = 4
#: Vectors and visitors of a cell that are compared at a time.
BLOCK_ROWS = 512
#: Vectors whose distances to all codewords are held at a time.
BLOCK = 4_096
#: Vectors for each cell of a label's grid, on average, before codebooks reach their largest size.
CELL_ROWS = 64
FEWEST_CODES, MOST_CODES = 16, 1024
#: Coordinates and codewords are multiples of this where a vector's cells are told: sums of products of such numbers,
#: of up to 1 each, are exact in double precision, in whatever order they are added.
STEP = 2.0**-20
#: Bytes of vectors, and of their visitors, in a block of a region; the visitors pass by.
HOST_BYTES, GUEST_BYTES = 24 << 20, 120 << 20
MOST_SIDE = 64
#: Bytes that a round deals out: so many in any case, and so many times those of the vectors.
ROUND_BYTES, ROUND_SHARE = 256 << 20, 1.25
#: Visitors that are held at a time.
GUEST_ROWS = 32_768


def _unit(values: np.ndarray) -> np.ndarray:
    """The vectors over their lengths; rows that have none aren't finite. A row's result is the same in any batch."""
    values = values.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        values = values / np.abs(values).max(axis=1, keepdims=True, initial=0)
        return values / np.sqrt((values * values).sum(axis=1, keepdims=True)) + 0.0


def _told(rows: DataFrame, dims: int, kind: np.dtype) -> DataFrame:
    """(vec_id, label, raw, digest): the vector's bytes, and a digest of its unit vector and label; null where it
    links with nothing."""
    size = dims * 8

    def run(batches):
        for batch in batches:
            column, labels = batch.column("vector"), batch.column("label")
            right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
            right = pc.and_(right, pc.is_valid(labels))
            index = np.flatnonzero(right.to_numpy(zero_copy_only=False))
            values = column.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False)
            values = values.astype(kind, copy=False).reshape(-1, dims)
            unit = _unit(values)
            good = np.isfinite(unit).all(axis=1)
            index, values, units = index[good], values[good].tobytes(), memoryview(unit[good].tobytes())
            names = labels.take(pa.array(index)).to_pylist()
            digests = [blake2b(bytes(units[i * size : i * size + size]) + name.encode(), digest_size=16) for i, name in enumerate(names)]
            lengths = np.zeros(batch.num_rows + 1, np.int32)
            lengths[index + 1] = 1
            ends, bits = np.cumsum(lengths, dtype=np.int32), np.packbits(lengths[1:].astype(bool), bitorder="little").tobytes()
            raw, digest = (
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [pa.py_buffer(x) for x in (bits, (ends * wide).tobytes(), data)])
                for wide, data in ((dims * kind.itemsize, values), (16, b"".join(d.digest() for d in digests)))
            )
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), labels, raw, digest], names=["vec_id", "label", "raw", "digest"])

    return rows.mapInArrow(run, "vec_id long, label string, raw binary, digest binary")


def _bytes(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What the values of a binary column without nulls hold, one after the other, and their numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(held.tobytes(), kind), np.diff(ends) // np.dtype(kind).itemsize


def _matrix(column, dims: int, kind: np.dtype) -> np.ndarray:
    """The unit vectors of a column of vectors' bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(_bytes(column, kind)[0].reshape(-1, dims))


def _stepped(values: np.ndarray) -> np.ndarray:
    return np.rint(values / STEP) * STEP


def _codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means, starting from rows at equal steps."""
    size = min(size, len(points))
    centers = points[np.linspace(0, len(points) - 1, size).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate(
            [_distances(points[i : i + BLOCK], centers).argmin(axis=1) for i in range(0, len(points), BLOCK)]
        )
        counts = np.bincount(nearest, minlength=size)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances."""
    out = (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)
    return np.maximum(out, 0)


class Grid:
    """The product grid of two codebooks, and its regions: products of `side` groups of codewords each."""

    def __init__(self, sample: np.ndarray, codes: int, side: int = 1):
        self.half = sample.shape[1] // 2
        self.first = _stepped(_codebook(sample[:, : self.half], codes))
        self.second = _stepped(_codebook(sample[:, self.half :], codes))
        self.groups = [self._grouped(codewords, side) for codewords in (self.first, self.second)]
        self.side = max(len(groups) for groups in self.groups)
        self.region_first, self.region_second = (np.zeros(len(x), np.int64) for x in (self.first, self.second))
        for region, groups in ((self.region_first, self.groups[0]), (self.region_second, self.groups[1])):
            for i, group in enumerate(groups):
                region[group] = i

    @staticmethod
    def _grouped(codewords: np.ndarray, side: int) -> list[np.ndarray]:
        near = _distances(codewords, _codebook(codewords, side)).argmin(axis=1)
        return [group for i in range(side) if (group := np.flatnonzero(near == i)).size]

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors = _stepped(vectors)
        return _distances(vectors[:, : self.half], self.first), _distances(vectors[:, self.half :], self.second)

    def homes(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)

    def regions_of(self, homes: np.ndarray) -> np.ndarray:
        return self.region_first[homes // len(self.second)] * self.side + self.region_second[homes % len(self.second)]

    @staticmethod
    def _first_pairs(one: np.ndarray, two: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of both halves' codewords among which the `n` nearest cells are.

        With both halves' codewords in order of distance, the pair (a, b) has (a+1)(b+1)-1 pairs that are
        no farther, so only pairs with (a+1)(b+1) <= n need a look.
        """
        return np.nonzero(np.outer(np.arange(1, one.shape[1] + 1), np.arange(1, two.shape[1] + 1)) <= n)

    def visits(self, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
        """The `n` nearest cells of each vector, nearest first; the home cell leads."""
        n = min(n, one.shape[1] * two.shape[1])
        order_one, order_two = one.argsort(axis=1, kind="stable"), two.argsort(axis=1, kind="stable")
        a, b = self._first_pairs(one, two, n)
        rows = np.arange(len(one))[:, None]
        sums = one[rows, order_one[:, a]] + two[rows, order_two[:, b]]
        best = sums.argsort(axis=1, kind="stable")[:, :n]
        return order_one[rows, a[best]] * len(self.second) + order_two[rows, b[best]]

    def reaches(self, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
        """The distance of each vector's `n`-th nearest cell. It visits all cells that are no farther."""
        n = min(n, one.shape[1] * two.shape[1])
        one, two = np.sort(one, axis=1), np.sort(two, axis=1)
        a, b = self._first_pairs(one, two, n)
        return np.partition(one[:, a] + two[:, b], n - 1, axis=1)[:, n - 1]

    def regions(self, one: np.ndarray, two: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which regions hold cells within reach, a row for each vector."""
        near = np.full((len(one), self.side, self.side), np.inf)
        for i, first in enumerate(self.groups[0]):
            for j, second in enumerate(self.groups[1]):
                near[:, i, j] = one[:, first].min(axis=1) + two[:, second].min(axis=1)
        return (near <= reach[:, None, None]).reshape(len(one), -1)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest mark of each node's component in a bipartite graph."""
    far = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(links, left[:, None], far).min(axis=0))
        new_left = np.minimum(left, np.where(links, new_right[None], far).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


class Verifier:
    """Which pairs of unit vectors have a cosine of the threshold or more."""

    def __init__(self, threshold: float, dims: int):
        self.threshold = threshold
        # What rounding to single precision and adding there can change, at most.
        self.margin = (dims + 8) * 2.0**-23

    def pairs(self, left32: np.ndarray, right32: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both sides; `left32` and `right32` are `left` and `right` in single precision, `left` can be a function of rows."""
        cosines = left32 @ right32.T
        if not cosines.size or cosines.max() < self.threshold - self.margin:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.divmod(np.flatnonzero(cosines >= self.threshold - self.margin), len(right32))  # faster than with two axes
        sure = cosines[i, j] >= self.threshold + self.margin
        doubt = np.flatnonzero(~sure)
        for first in range(0, len(doubt), BLOCK):
            some = doubt[first : first + BLOCK]
            sure[some] = np.einsum("ij,ij->i", left(i[some]), right(j[some])) >= self.threshold
        return i[sure], j[sure]


class Traversal:
    """The cells in the order in which each of some vectors visits them."""

    def __init__(self, grid: Grid, vectors: np.ndarray):
        self.one, self.two = grid.distances(vectors)
        self.ordered = np.sort(self.two, axis=1)

    @property
    def cells(self) -> int:
        return self.one.shape[1] * self.two.shape[1]

    def place(self, q: int, cell: int) -> int:
        """How many cells come before `cell` for vector `q`."""
        far = self.one[q, cell // self.two.shape[1]] + self.two[q, cell % self.two.shape[1]]
        return int(np.searchsorted(self.ordered[q], far - self.one[q], side="left").sum())


def _needed(places: list[tuple[int, int]], target: float) -> int:
    """How many cells hold `target` of what lies at these places, as (place, number) in order of places."""
    total, have = sum(n for _, n in places), 0
    for place, n in places:
        have += n
        if have >= target * total:
            return place + 1
    return 1


def _planted_visits(queries: np.ndarray, grid: Grid, threshold: float, target: float) -> int:
    """How many cells the traversal visits to find neighbours whose cosine is just the threshold."""
    rng = np.random.default_rng(len(queries))
    traversal, places = Traversal(grid, queries), []
    for _ in range(PLANTED):
        aside = rng.standard_normal(queries.shape)
        aside -= (aside * queries).sum(axis=1, keepdims=True) * queries
        length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        if not (length > 0).all():  # one dimension has no aside
            continue
        near = threshold * queries + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside / length
        homes = grid.homes(*grid.distances(near))
        places += [traversal.place(q, int(cell)) for q, cell in enumerate(homes)]
    at, n = np.unique(np.array(places, np.int64), return_counts=True)
    return _needed(list(zip(at.tolist(), n.tolist())), target)


def _measured_visits(
    classes: DataFrame, sample: pa.Table, grid: Grid, dims: int, kind: np.dtype, threshold: float, target: float
) -> int:
    """How many cells the traversal visits so that the queries find `target` of their links."""
    queries = _matrix(sample.column("raw"), dims, kind)
    queries32 = queries.astype(np.float32)
    names, labels = sample.column("cid").to_numpy(), np.array(sample.column("label").to_pylist(), object)
    traversal, verifier = Traversal(grid, queries), Verifier(threshold, dims)

    def run(batches):
        for batch in batches:
            places = np.zeros(traversal.cells, np.int64)
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                vectors = _matrix(part.column("raw"), dims, kind)
                i, q = verifier.pairs(vectors.astype(np.float32), queries32, vectors.__getitem__, queries.__getitem__)
                cid, label = part.column("cid").to_numpy(), np.array(part.column("label").to_pylist(), object)
                found = (cid[i] != names[q]) & (label[i] == labels[q])
                i, q = i[found], q[found]
                if not i.size:
                    continue
                homes = grid.homes(*grid.distances(vectors))
                visited, n = np.unique(q * traversal.cells + homes[i], return_counts=True)
                for one, times in zip(visited.tolist(), n.tolist()):
                    places[traversal.place(*divmod(one, traversal.cells))] += times
            at = np.flatnonzero(places)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(places[at])], names=["place", "n"])

    counts = classes.select("cid", "label", "raw").mapInArrow(run, "place long, n long")
    counts = counts.groupBy("place").agg(F.sum("n").alias("n")).orderBy("place")
    return _needed([(r.place, r.n) for r in counts.collect()], target)  # at most one row per cell of the grid


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    threshold: float = 0.93,
    target_recall: float = 0.995,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    given = vectors.select(vector).schema[0].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"),
    )
    with shuffles_dropped(bounded_batches(vectors.sparkSession)):
        usual = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").head()
        dims = usual[0] if usual else 1
        told = _told(rows, dims, kind)
        ids = scratch_table(told.select("vec_id", "digest"), "vector-ids")
        classes, seen = measured_table(
            told.where("digest is not null")
            .groupBy("digest")
            .agg(
                F.min("vec_id").alias("least"), F.count("*").alias("copies"),
                F.any_value("label").alias("label"), F.any_value("raw").alias("raw"),
            )
            .withColumn("cid", F.monotonically_increasing_id()),
            "vector-classes",
        )
        alone = F.lit(0).cast("long")
        if not seen["n"]:
            found = ids.select("vec_id", alone.alias("n_links"), F.col("vec_id").alias("component_id"))
        else:
            named = _linked(classes, seen["n"], dims, kind, threshold, target_recall)
            found = ids.join(named, "digest", "left").select(
                "vec_id", F.coalesce("n_links", alone).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
            )
    return found.select(
        F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _mixed(*numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of several numbers each."""
    out = np.uint64(0)
    for number in numbers:
        out = (out ^ number.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out = out ^ (out >> np.uint64(29))
    return out


class Deal:
    """Where vectors and visitors go: groups are a label's vectors of a region; large ones have several blocks.

    A meeting of two blocks has a round and a part of it: those of `large` groups the least full ones, any others
    by their hash.
    """

    def __init__(self, large: list, host_rows: int, guest_rows: int):
        groups = _mixed(np.array([r.kin for r in large], np.int64), np.array([r.region for r in large], np.int64))
        order = groups.argsort()
        self.groups = groups[order]
        rows = [np.array(x, np.int64)[order] for x in ([r.hosts for r in large], [r.guests for r in large])]
        self.hosts, self.guests = (np.maximum(-(-x // most), 1) for x, most in zip(rows, (host_rows, guest_rows)))
        #: Rows that are sent once more than to one block of the other side.
        self.more = int((rows[0] * (self.guests - 1) + rows[1] * (self.hosts - 1)).sum())
        times = self.hosts * self.guests
        at, block = np.repeat(np.arange(len(times)), times), ragged(np.zeros(len(times), np.int64), times)
        meetings = _mixed(self.groups[at], block // self.guests[at], block % self.guests[at])
        order = meetings.argsort()
        self.listed, self.rows = meetings[order], (rows[0] // self.hosts + rows[1] // self.guests)[at][order]

    def spread(self, rounds: int, slots: list[int]) -> None:
        """Share out the listed meetings to rounds, and to parts with these names."""
        self.rounds, self.slots = rounds, np.array(slots, np.int64)
        self.round, self.part = np.zeros(len(self.listed), np.int64), np.zeros(len(self.listed), np.int64)
        loads, taken = [(0, k) for k in range(rounds)], [0] * rounds
        for i in (-self.rows).argsort(kind="stable").tolist():
            load, k = heappop(loads)
            self.round[i], self.part[i] = k, slots[taken[k] % len(slots)]
            taken[k] += 1
            heappush(loads, (load + int(self.rows[i]), k))

    def goes(self, meetings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each meeting's round and part."""
        rounds = (meetings % np.uint64(self.rounds)).astype(np.int64)
        parts = self.slots[(meetings // np.uint64(self.rounds) % np.uint64(len(self.slots))).astype(np.int64)]
        if not self.listed.size:
            return rounds, parts
        at = np.minimum(np.searchsorted(self.listed, meetings), len(self.listed) - 1)
        known = self.listed[at] == meetings
        return np.where(known, self.round[at], rounds), np.where(known, self.part[at], parts)

    def _blocks(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.groups.size:
            return np.ones(len(groups), np.int64), np.ones(len(groups), np.int64)
        at = np.minimum(np.searchsorted(self.groups, groups), len(self.groups) - 1)
        known = self.groups[at] == groups
        return np.where(known, self.hosts[at], 1), np.where(known, self.guests[at], 1)

    def meetings(self, kin: np.ndarray, cid: np.ndarray, region: np.ndarray, guest: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, meeting): each row's block with every block of the other side."""
        groups = _mixed(kin, region)
        own, other = self._blocks(groups)[:: -1 if guest else 1]
        block = (_mixed(cid) % own.astype(np.uint64)).astype(np.int64)
        rows = np.repeat(np.arange(len(groups)), other)
        every = ragged(np.zeros(len(groups), np.int64), other)
        return rows, _mixed(groups[rows], *((every, block[rows]) if guest else (block[rows], every)))


class Region:
    """Vectors of some groups that wait for visitors; counts their links and joins what links."""

    def __init__(self, records: np.ndarray, grid: Grid, verifier: Verifier, dims: int, kind: np.dtype):
        self.grid, self.verifier, self.dims, self.kind = grid, verifier, dims, kind
        self.hosts = hosts = records[np.lexsort((records["home"], records["meeting"]))]
        self.single = np.concatenate([self._vectors(hosts[i : i + BLOCK]).astype(np.float32) for i in range(0, len(hosts), BLOCK)])
        self.counts, self.marks = np.zeros(len(hosts), np.int64), hosts["cid"].copy()
        starts = np.flatnonzero(np.diff(hosts["meeting"]) != 0) + 1
        starts = [0, *starts.tolist(), len(hosts)]
        self.meetings = {int(hosts["meeting"][low]): [*self._cells(low, high)] for low, high in zip(starts, starts[1:])}

    def _vectors(self, records: np.ndarray) -> np.ndarray:
        return _unit(np.frombuffer(records["raw"].tobytes(), self.kind).reshape(-1, self.dims))

    def _cells(self, start: int, end: int):
        """(cell, start, end) of the vectors of one cell, at most `BLOCK_ROWS`."""
        homes = self.hosts["home"][start:end]
        cuts = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)]
        for first, last in zip(cuts, cuts[1:]):
            for at in range(first, last, BLOCK_ROWS):
                yield int(homes[first]), start + at, start + min(last, at + BLOCK_ROWS)

    def meet(self, records: np.ndarray):
        """Visitors pass by; gives (a, b, edge): links of visitors, and edges."""
        if not len(records):
            return
        records = records[records["meeting"].argsort(kind="stable")]
        cuts = [0, *(np.flatnonzero(np.diff(records["meeting"]) != 0) + 1).tolist(), len(records)]
        for first, last in zip(cuts, cuts[1:]):
            here = self.meetings.get(int(records["meeting"][first]))
            if here:
                yield from self._group(here, records[first:last])

    def _group(self, cells: list[tuple[int, int, int]], guests: np.ndarray):
        grid, width = self.grid, len(self.grid.second)
        vectors = self._vectors(guests)
        single, stepped = vectors.astype(np.float32), _stepped(vectors)
        home = cells[0][0]
        first = np.flatnonzero(grid.region_first == grid.region_first[home // width])
        second = np.flatnonzero(grid.region_second == grid.region_second[home % width])
        one = np.ascontiguousarray(_distances(stepped[:, : grid.half], grid.first[first]).T)
        room = guests["reach"] - np.ascontiguousarray(_distances(stepped[:, grid.half :], grid.second[second]).T)
        row_one, row_two = np.zeros(len(grid.first), np.int64), np.zeros(width, np.int64)
        row_one[first], row_two[second] = np.arange(len(first)), np.arange(len(second))
        counts, marks = np.zeros(len(guests), np.int64), guests["cid"].copy()
        for cell, low, high in cells:
            came = np.flatnonzero(one[row_one[cell // width]] <= room[row_two[cell % width]])
            for at in range(0, len(came), BLOCK_ROWS):
                some = came[at : at + BLOCK_ROWS]
                i, j = self.verifier.pairs(
                    self.single[low:high], single[some],
                    lambda rows: self._vectors(self.hosts[low + rows]), lambda rows: vectors[some[rows]],
                )
                other = self.hosts["cid"][low + i] != guests["cid"][some[j]]
                if other.any():
                    yield from self._link(low, high, guests, some, i[other], j[other], counts, marks)
        found = counts > 0
        if found.any():
            yield guests["cid"][found], counts[found], False

    def _link(self, low: int, high: int, guests: np.ndarray, some: np.ndarray, i: np.ndarray, j: np.ndarray, counts: np.ndarray, marks: np.ndarray):
        hosts, width = self.hosts[low:high], len(self.grid.second)
        counts[some] += np.bincount(j, hosts["copies"][i], len(some)).astype(np.int64)
        # A host that visits its guest's home counts the guest there.
        which, row = np.unique(i, return_inverse=True)
        one, two = self.grid.distances(self._vectors(hosts[which]))
        home = guests["home"][some[j]]
        once = one[row, home // width] + two[row, home % width] > hosts["reach"][i]
        self.counts[low:high] += np.bincount(i[once], guests["copies"][some[j[once]]], high - low).astype(np.int64)
        whose, column = np.unique(j, return_inverse=True)
        links = np.zeros((len(which), len(whose)), bool)
        links[row, column] = True
        which, whose = low + which, some[whose]
        left, right = _forest(links, self.marks[which], marks[whose])
        for nodes, held, at, new in ((self.hosts["cid"], self.marks, which, left), (guests["cid"], marks, whose, right)):
            # Every mark that a node ever had is one that it is joined with.
            less = new < held[at]
            if less.any():
                held[at[less]] = new[less]
                yield nodes[at[less]], new[less], True

    def end(self):
        found = self.counts > 0
        if found.any():
            yield self.hosts["cid"][found], self.counts[found], False


def _linked(classes: DataFrame, n: int, dims: int, kind: np.dtype, threshold: float, target: float) -> DataFrame:
    """(digest, n_links, component) of every class."""
    width = dims * kind.itemsize
    record = np.dtype(
        [("meeting", "<u8"), ("cid", "<i8"), ("copies", "<i8"), ("reach", "<f8"), ("home", "<i4"), ("raw", f"V{width}")]
    )
    host_rows, guest_rows = (max(1, size // record.itemsize) for size in (HOST_BYTES, GUEST_BYTES))
    # How many vectors there are of a vector's label, on average.
    usual = classes.groupBy("label").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).head()[0] / n
    codes = int(np.clip(np.sqrt(usual / CELL_ROWS), FEWEST_CODES, MOST_CODES))
    side = int(np.clip(np.ceil(np.sqrt(usual / host_rows)), 1, min(codes, MOST_SIDE)))
    sample = sampled(classes, n, max(SAMPLE_ROWS, CODE_ROWS * codes), "digest")
    picked = sample.orderBy(F.xxhash64("digest")).select("cid", "label", "raw").toArrow()
    grid = Grid(_matrix(picked.column("raw"), dims, kind), codes, side)
    queries = picked.slice(0, QUERY_ROWS)
    vectors = _matrix(queries.column("raw"), dims, kind)
    visits = max(
        _planted_visits(vectors, grid, threshold, target),
        _measured_visits(classes, queries, grid, dims, kind, threshold, target),
    )
    one, two = grid.distances(vectors)
    replicas = float(grid.regions(one, two, grid.reaches(one, two, visits)).sum(axis=1).mean())

    def place(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                one, two = grid.distances(_matrix(part.column("raw"), dims, kind))
                homes, reach = grid.homes(one, two), grid.reaches(one, two, visits)
                rows, regions = np.nonzero(grid.regions(one, two, reach))
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1)) * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("cid", "kin", "digest", "least", "copies", "raw")),
                        pa.array(reach), pa.array(homes.astype(np.int32)),
                        pa.Array.from_buffers(
                            pa.binary(), part.num_rows,
                            [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(regions.astype("<u2").tobytes())],
                        ),
                    ],
                    names=["cid", "kin", "digest", "least", "copies", "raw", "reach", "home", "regions"],
                )

    placed = scratch_table(
        classes.select("cid", F.xxhash64("label").alias("kin"), "digest", "least", "copies", "raw").mapInArrow(
            place,
            "cid long, kin long, digest binary, least long, copies long, raw binary, reach double, home int, regions binary",
        ),
        "vector-places",
    )
    drop_scratch(classes)

    def visited(part) -> tuple[np.ndarray, np.ndarray]:
        regions, n = _bytes(part.column("regions"), np.dtype("<u2"))
        return np.repeat(np.arange(part.num_rows), n), regions.astype(np.int64)

    def sizes(batches):
        for batch in batches:
            kin = batch.column("kin").to_numpy()
            homes = grid.regions_of(batch.column("home").to_numpy())
            rows, regions = visited(batch)
            both = np.concatenate([kin, kin[rows]]), np.concatenate([homes, regions])
            pairs, at = np.unique(np.stack(both, axis=1), axis=0, return_inverse=True)
            hosts, guests = (np.bincount(x, minlength=len(pairs)) for x in (at[: len(kin)], at[len(kin) :]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (pairs[:, 0], pairs[:, 1], hosts, guests)], names=["kin", "region", "hosts", "guests"]
            )

    def rounds_for(rows: float) -> int:
        return int(np.ceil(rows * record.itemsize / max(ROUND_BYTES, ROUND_SHARE * n * width)))

    large: list = []
    sent = n * (replicas + 1)
    if n > host_rows or n * replicas > guest_rows or rounds_for(sent) > 1:
        counted = placed.select("kin", "home", "regions").mapInArrow(sizes, "kin long, region long, hosts long, guests long")
        counted = counted.groupBy("kin", "region").agg(F.sum("hosts").alias("hosts"), F.sum("guests").alias("guests"))
        blocks = (F.col("hosts") > host_rows) | (F.col("guests") > guest_rows)
        # No more of them than blocks, and than some shares of all rounds.
        large = counted.where(blocks | (F.col("hosts") + F.col("guests") > int(sent / rounds_for(sent) / 16))).collect()
    deal, verifier = Deal(large, host_rows, guest_rows), Verifier(threshold, dims)
    sent += deal.more
    rounds = rounds_for(sent)
    parts = int(max(16, sent / rounds * record.itemsize // (HOST_BYTES + GUEST_BYTES) * 2))
    # Numbers that Spark's hash deals to one partition each.
    numbers = classes.sparkSession.range(16 * parts).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))).agg(F.min("id"))
    deal.spread(rounds, sorted(r[1] for r in numbers.collect()))
    met = reduce(
        DataFrame.union,
        [scratch_table(_met(placed, record, deal, grid, verifier, (dims, kind), visited, k, parts), "vector-links") for k in range(rounds)],
    )
    counts = met.where("not edge").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n"))
    reached = components(met.where("edge").select("a", "b")).withColumnRenamed("node", "cid")
    grouped = placed.select("cid", "digest", "least", "copies").join(reached, "cid", "left")
    grouped = grouped.withColumn("group", F.coalesce("component", "cid")).drop("component")
    least = grouped.groupBy("group").agg(F.min("least").alias("component"))
    return (
        grouped.join(least, "group")
        .join(counts, "cid", "left")
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    )


def _met(
    placed: DataFrame, record: np.dtype, deal: Deal, grid: Grid, verifier: Verifier, shape: tuple, visited, now: int, parts: int
) -> DataFrame:
    """(a, b, edge) of the meetings of one round: links of class a, or an edge between classes."""

    def send(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                kin, cid = part.column("kin").to_numpy(), part.column("cid").to_numpy()
                records = np.zeros(part.num_rows, record)
                for name in ("cid", "copies", "reach", "home"):
                    records[name] = part.column(name).to_numpy()
                records["raw"] = _bytes(part.column("raw"), record["raw"])[0]
                guest, region = visited(part)
                hosts, host_meetings = deal.meetings(kin, cid, grid.regions_of(records["home"]), False)
                guests, guest_meetings = deal.meetings(kin[guest], cid[guest], region, True)
                rows, meetings = np.concatenate([hosts, guest[guests]]), np.concatenate([host_meetings, guest_meetings])
                comes = np.repeat([False, True], [len(hosts), len(guests)])
                times, goes = deal.goes(meetings)
                here = np.flatnonzero(times == now)
                goes = goes[here] * 2 + comes[here]
                order = goes.argsort(kind="stable")
                goes, here = goes[order], here[order]
                cuts = np.flatnonzero(np.diff(goes, prepend=-1))
                records = records[rows[here]]
                records["meeting"] = meetings[here]
                ends = np.append(cuts, len(goes)).astype(np.int32) * record.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(records.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((goes[cuts] // 2).astype(np.int32)), pa.array(goes[cuts] % 2 == 1), blobs], names=["part", "guest", "rows"]
                )

    def run(batches):
        part, waiting, n, region = None, [], 0, None

        def passed():
            return region.meet(np.frombuffer(b"".join(waiting), record))

        def ended():
            if region:
                yield from passed()
                yield from region.end()

        def given(found):
            kept = [(a, b, np.full(len(a), edge)) for a, b, edge in found]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*kept)], names=["a", "b", "edge"])

        for batch in batches:
            for to, guest, rows in zip(*(batch.column(c) for c in ("part", "guest", "rows"))):
                if to.as_py() != part:
                    yield from given(ended())
                    part, waiting, n, region = to.as_py(), [], 0, None
                if guest.as_py() and region is None:  # all vectors of the part have come
                    region = Region(np.frombuffer(b"".join(waiting), record), grid, verifier, *shape) if waiting else None
                    if region is None:
                        continue
                    waiting, n = [], 0
                waiting.append(rows.as_py())
                n += len(waiting[-1]) // record.itemsize
                if guest.as_py() and n >= GUEST_ROWS:
                    yield from given(passed())
                    waiting, n = [], 0
        yield from given(ended())

    sent = placed.select("cid", "kin", "copies", "raw", "reach", "home", "regions").mapInArrow(send, "part int, guest boolean, rows binary")
    sent = sent.repartition(parts, "part").sortWithinPartitions("part", "guest")
    return sent.mapInArrow(run, "a long, b long, edge boolean")
