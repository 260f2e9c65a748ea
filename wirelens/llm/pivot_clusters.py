"""Centroid clustering of integer vectors with a LAESA pivot table.

Each component x becomes floor(256 * x). The distances of all vectors to `PIVOTS` fixed vectors are computed
once and stored with them. In every round the distances of the centroids to the pivots are known too, and by
the triangle inequality the largest difference of the two bounds a vector's distance to a centroid from below.
The centroid of least bound is measured first; only centroids whose bound isn't above that distance get
exact integer distances. Stored distances are rounded down, which the bounds allow for, so the nearest
centroid is always found, the smaller number at equal distances.

A round is one pass over the stored table: tasks add up their vectors per centroid, Spark adds up the tasks'
sums, and one row per centroid comes to the driver for the exact floors. A lost task is run again from the table.

Defined results: vectors that are null, of other lengths, or hold nulls or numbers that aren't finite are left
out, as are those beyond +-2^19 in a component, whose squared distances may not fit a long. Rows without an id
take part but start no centroid. Repeated rows count each; of rows of one id the smallest vector starts a
centroid. Fewer vectors than centroids give fewer centroids, an empty table no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.session import measured_table

SCALE, DIMENSIONS = 256, 64
LARGEST = float(1 << 19)
PIVOTS = 16
#: Vectors that a task works on at a time.
AT_ONCE = 1 << 13


def kept_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, units) of the vectors that take part, with integer components."""
    v = F.col(vector).cast("array<double>")
    usable = (F.size(v) == dimensions) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST))
    )
    units = F.transform(v, lambda x: F.floor(x * F.lit(float(SCALE))).cast("int"))
    return rows.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("key"), units.alias("units"))


def first_by_hash(vectors: DataFrame, seed: int, n: int) -> np.ndarray:
    """The `n` vectors of smallest hash of seed and id, in ascending order of hashes."""
    named = vectors.where("key is not null").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256).alias("hash"), "units"
    )
    rows = named.orderBy("hash", "units").limit(2 * n).collect()
    chosen = {r.hash: r.units for r in reversed(rows)}
    if len(chosen) < n and len(rows) == 2 * n:  # ids that come several times
        rows = named.groupBy("hash").agg(F.min("units").alias("units")).orderBy("hash").limit(n).collect()
        chosen = {r.hash: r.units for r in rows}
    return np.array([chosen[h] for h in sorted(chosen)[:n]], np.int64)


def _squared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    apart = one - other
    return np.einsum("ij,ij->i", apart, apart)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots rounded to integers, off by less than one."""
    return np.sqrt(squares.astype(np.float64)).astype(np.int64)


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table's rows: rounded distances of vectors to all pivots."""
    return np.stack([_roots(_squared(vectors, p)) for p in pivots], axis=1).reshape(len(vectors), len(pivots))


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, the squared distance, and how many distances were computed."""
    of_centroids = to_pivots(centroids, pivots)
    below = np.zeros((len(vectors), len(centroids)), np.int64)
    for k in range(len(pivots)):
        np.maximum(below, np.abs(table[:, k, None] - of_centroids[None, :, k]), out=below)
    below = np.maximum(below - 2, 0)  # both sides are rounded
    best = below.argmin(axis=1)
    distance = _squared(vectors, centroids[best])
    below *= below
    asked = below <= distance[:, None]
    asked[np.arange(len(vectors)), best] = False
    computed = len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero(asked[:, c])
        rows = rows[below[rows, c] <= distance[rows]]
        found = _squared(vectors[rows], centroids[c])
        better = (found < distance[rows]) | ((found == distance[rows]) & (c < best[rows]))
        distance[rows[better]], best[rows[better]] = found[better], c
        computed += len(rows)
    return best, distance, computed


def _numbers(column: pa.Array, kind=np.int32) -> np.ndarray:
    """The rows of a column of equally long byte strings."""
    width = len(column[0].as_py())
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    first = offsets[column.offset]
    return raw[first : first + width * len(column)].view(kind).reshape(len(column), -1).astype(np.int64)


def _bytes(rows: np.ndarray, kind=np.int32) -> pa.Array:
    raw = np.ascontiguousarray(rows.astype(kind))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (raw.nbytes // max(1, len(rows)))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(key, units, pivot_distances): the vectors as bytes, with their distances to all pivots."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                units = part.column("units").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), _bytes(units), _bytes(to_pivots(units, pivots))],
                    names=["key", "units", "pivot_distances"],
                )

    return vectors.mapInArrow(run, "key long, units binary, pivot_distances binary")


def _parts(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            yield part.column("key"), _numbers(part.column("units")), _numbers(part.column("pivot_distances"))


def next_centroids(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The exact floors of the means of each centroid's vectors; centroids without vectors stay."""

    def run(batches):
        n, width = centroids.shape
        totals, counts = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
        for _, units, table in _parts(batches):
            best, _, _ = nearest(units, table, centroids, pivots)
            order = np.argsort(best, kind="stable")
            heads = np.flatnonzero(np.diff(best[order], prepend=-1))
            totals[best[order][heads]] += np.add.reduceat(units[order], heads, axis=0)
            counts += np.bincount(best, minlength=n)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(there, pa.int32()), "n": counts[there], "totals": pa.array(totals[there].tolist(), pa.list_(pa.int64()))}
        )

    sums = (
        stored.mapInArrow(run, "cluster int, n long, totals array<long>")
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(centroids.shape[1])])
    )
    moved = centroids.copy()
    for cluster, n, *totals in sums.collect():  # one row per centroid
        moved[cluster] = [total // n for total in totals]
    return moved


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = 40,
    rounds: int = 5,
    seed: int = 2,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of all vectors that take part.

    Centroids start as the vectors of smallest hash; the pivots are the next ones by hash. `centroid` holds the
    components of the row's final centroid.
    """
    spark = rows.sparkSession
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    vectors, _ = measured_table(kept_vectors(rows, key, vector, dimensions), "vectors")
    chosen = first_by_hash(vectors, seed, clusters + PIVOTS)
    if not len(chosen):
        return spark.createDataFrame([], schema)
    centroids = chosen[:clusters]
    pivots = chosen[clusters:] if len(chosen) > clusters else chosen[:PIVOTS]
    stored, _ = measured_table(pivot_table(vectors, pivots), "pivot-table")
    for _ in range(rounds):
        centroids = next_centroids(stored, centroids, pivots)

    def place(batches):
        for keys, units, table in _parts(batches):
            best, distance, _ = nearest(units, table, centroids, pivots)
            yield pa.RecordBatch.from_arrays([keys, pa.array(best, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"])

    placed, _ = measured_table(stored.mapInArrow(place, "key long, cluster int, distance long"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row per centroid
    inertia = sum(r.s for r in sums)
    named = spark.createDataFrame(
        [(r.cluster, r.s, inertia, centroids[r.cluster].tolist()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return placed.withColumnRenamed("key", key).join(F.broadcast(named), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
