"""Local outlier factor (Breunig et al., 2000) with exact nearest neighbours.

Equal rows are merged with a weight first, as many windows may be alike (all idle ones are). The
neighbour search is split into cells: a tree of cuts, made from a sample, deals the rows into cells of
about equal size, and each cell has the box that its rows fill. The distance to the k-th neighbour inside
its own cell bounds how far a row has to look, so it is sent to those other cells only whose box is that
near. The bounds are safe, so the result is that of comparing everything with everything.

A task holds one cell's own rows; rows that look into the cell pass by in batches, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.operators.anomaly.prepare import beside_models
from wirelens.operators.features import FEATURE_NAMES
from wirelens.session import scratch_table

NEIGHBOURS = 20
CELL_ROWS = 1_000
#: Rows of the sample for each cell, and for the tree of a capture at most.
SAMPLE_OF_CELL = 32
SAMPLE_ROWS = 200_000
#: Numbers in the temporary arrays of distances.
AT_ONCE = 2_000_000
TINY = 1e-10


def merge_equal_rows(rows: DataFrame) -> DataFrame:
    """Distinct vectors: id (lowest window), weight, and k for the capture."""
    return rows.groupBy("capture_id", "x").agg(
        F.min("w").alias("id"),
        F.count("*").alias("weight"),
        F.max("n").alias("n"),
        F.min_by("chunk", "w").alias("chunk"),
    ).withColumn("k", F.least(F.lit(NEIGHBOURS), F.col("n") - 1).cast("int"))


TREE_SCHEMA = (
    "capture_id string, feature array<int>, cut array<double>, lower array<int>, upper array<int>"
)


def _split(x: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """Feature, cut and rows up to the cut: of the widest features the first that splits evenly enough."""
    best, most = None, 0
    for feature in np.argsort(-x.std(axis=0), kind="stable"):
        column = x[:, feature]
        cut = np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2]
        if cut == column.max():
            if cut == column.min():
                continue
            cut = column[column < cut].max()
        below = column <= cut
        least = min(int(below.sum()), int((~below).sum()))
        if least > most:
            best, most = (int(feature), float(cut), below), least
        if 4 * least >= len(x):
            break
    return best


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tree of cuts over one capture's sample; a leaf is a cell."""
    x, leaf = np.vstack(pdf["x"].to_numpy()), max(1.0, float(pdf["leaf"].iloc[0]))
    feature, cut, lower, upper = [-1], [0.0], [-1], [-1]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, members = todo.pop()
        found = _split(x[members]) if len(members) >= 2 * leaf else None
        if found is None:
            continue
        feature[node], cut[node], below = found
        for side, part in ((lower, members[below]), (upper, members[~below])):
            side[node] = len(feature)
            todo.append((len(feature), part))
            for column, value in ((feature, -1), (cut, 0.0), (lower, -1), (upper, -1)):
                column.append(value)
    return pd.DataFrame(
        {
            "capture_id": [pdf["capture_id"].iloc[0]],
            "feature": [feature],
            "cut": [cut],
            "lower": [lower],
            "upper": [upper],
        }
    )


def grow_cells(points: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One tree per capture, from a sample by hash that always has the point with the lowest id."""
    sizes = points.groupBy("capture_id").agg(F.count("*").alias("points"), F.min("id").alias("lowest"))
    share = F.least(F.lit(SAMPLE_OF_CELL / cell_rows), F.lit(float(SAMPLE_ROWS)) / F.col("points"), F.lit(1.0))
    u = F.pmod(F.xxhash64(F.lit("cell"), "id"), F.lit(1 << 40)) / float(1 << 40)
    sample = (
        points.join(sizes.withColumn("share", share), "capture_id")
        .filter((u < F.col("share")) | (F.col("id") == F.col("lowest")))
        .select("capture_id", "x", (F.col("share") * cell_rows).alias("leaf"))
    )
    return sample.groupBy("capture_id").applyInPandas(_grow, TREE_SCHEMA)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, so that equal rows are at exactly zero."""
    out = np.empty((len(a), len(b)))
    step = max(1, AT_ONCE // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _to_cells(points: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    columns = ["capture_id", "chunk", "id", "weight", "k", "x"]
    if points.empty or trees.empty:
        return pd.DataFrame({c: [] for c in [*columns, "cell"]})
    tree = trees.iloc[0]
    feature, cut, lower, upper = (np.asarray(tree[c]) for c in ("feature", "cut", "lower", "upper"))
    x = np.vstack(points["x"].to_numpy())
    everyone, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    while (feature[at] >= 0).any():
        go_low = x[everyone, np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(feature[at] >= 0, np.where(go_low, lower[at], upper[at]), at)
    return points[columns].assign(cell=at)


def _bounds(pdf: pd.DataFrame) -> pd.DataFrame:
    """How far each of a cell's points has to look: to its k-th neighbour, copies counted, in the cell."""
    x, weight = np.vstack(pdf["x"].to_numpy()), pdf["weight"].to_numpy()
    k = int(pdf["k"].iloc[0])
    bound = np.full(len(x), np.inf)
    for block in _blocks(len(x), x.size):
        d = _distances(x[block], x)
        near = np.argpartition(d, k, axis=1)[:, : k + 1] if k + 1 < len(x) else np.tile(np.arange(len(x)), (len(d), 1))
        d = np.take_along_axis(d, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        d, near = np.take_along_axis(d, order, axis=1), np.take_along_axis(near, order, axis=1)
        own = np.arange(len(x))[block, None]
        enough = np.cumsum(weight[near] - (near == own), axis=1) >= k
        found = d[np.arange(len(d)), enough.argmax(axis=1)]
        bound[block] = np.where(enough.any(axis=1), found, np.inf)
    return pdf[["capture_id", "cell", "chunk", "id", "k", "x"]].assign(bound=bound)


def _visits(points: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    """The cells in which each point may have neighbours, its own among them."""
    columns = ["capture_id", "id", "k", "x", "bound"]
    if points.empty or boxes.empty:
        return pd.DataFrame({c: [] for c in [*columns, "cells"]})
    boxes = boxes.sort_values("cell")
    names, low, high = boxes["cell"].to_numpy(), np.vstack(boxes["low"].to_numpy()), np.vstack(boxes["high"].to_numpy())
    x, bound = np.vstack(points["x"].to_numpy()), points["bound"].to_numpy()
    home = points["cell"].to_numpy()
    cells = []
    for block in _blocks(len(x), low.size):
        part = x[block, None, :]
        gap = np.maximum(np.maximum(low[None] - part, part - high[None]), 0.0)
        gap = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        meets = (gap <= bound[block, None] * (1 + 1e-9)) | (names[None] == home[block, None])
        cells += [names[row] for row in meets]
    return points[columns].assign(cells=cells)


NEIGHBOUR_SCHEMA = (
    "capture_id string, id bigint, neighbour bigint, distance double, copies bigint, k int"
)


def _in_cell(homes: pd.DataFrame, looking: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Of a cell's points the nearest that lie within the bounds of those that look into it."""
    ids, weight, x = homes["id"].to_numpy(), homes["weight"].to_numpy(), np.vstack(homes["x"].to_numpy())
    points, own = np.vstack(looking["x"].to_numpy()), looking["id"].to_numpy()
    bound, k = looking["bound"].to_numpy(), int(looking["k"].iloc[0])
    for block in _blocks(len(points), x.size):
        d = _distances(points[block], x)
        row, col = np.nonzero(d <= bound[block, None] * (1 + 1e-12))
        distance = d[row, col]
        order = np.lexsort((ids[col], distance, row))
        row, col, distance = row[order], col[order], distance[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, distance = (a[rank <= k] for a in (row, col, distance))
        here = own[block][row]
        copies = weight[col] - (ids[col] == here)
        some = copies > 0
        yield pd.DataFrame(
            {
                "capture_id": looking["capture_id"].iloc[0],
                "id": here[some],
                "neighbour": ids[col[some]],
                "distance": distance[some],
                "copies": copies[some],
                "k": k,
            }
        )


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells one after the other, a cell's own points first, then those that look into it."""
    key, homes = None, []
    for pdf in batches:
        for (capture, cell, looks), part in pdf.groupby(["capture_id", "cell", "looks"], sort=False):
            if (capture, cell) != key:
                key, homes = (capture, cell), []
            if not looks:
                homes.append(part)
                continue
            if len(homes) > 1:
                homes = [pd.concat(homes)]
            yield from _in_cell(homes[0], part)


def nearest_neighbours(
    points: DataFrame, chunks: DataFrame, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(capture_id, id, neighbour, distance, share, k): the k nearest, `share` copies of each."""
    kind = "capture_id string, chunk int, id bigint, weight bigint, k int, x array<double>, cell bigint"
    trees = scratch_table(grow_cells(points, cell_rows), "lof-trees")
    placed = beside_models(
        points.select("capture_id", "chunk", "id", "weight", "k", "x"), trees, _to_cells, kind, chunks
    )
    placed = scratch_table(placed, "lof-cells")
    of_cell = placed.groupBy("capture_id", "cell")
    x = [F.col("x")[i] for i in range(len(FEATURE_NAMES))]
    boxes = of_cell.agg(F.array(*map(F.min, x)).alias("low"), F.array(*map(F.max, x)).alias("high"))
    bounded = of_cell.applyInPandas(
        _bounds, "capture_id string, cell bigint, chunk int, id bigint, k int, x array<double>, bound double"
    )
    visits = beside_models(
        bounded,
        scratch_table(boxes, "lof-boxes"),
        _visits,
        "capture_id string, id bigint, k int, x array<double>, bound double, cells array<bigint>",
        chunks,
    )
    looking = visits.select(
        "capture_id", F.explode("cells").alias("cell"), F.lit(True).alias("looks"), "id",
        F.lit(None).cast("bigint").alias("weight"), "k", "x", "bound",
    )
    homes = placed.select(
        "capture_id", "cell", F.lit(False).alias("looks"), "id", "weight", "k", "x",
        F.lit(None).cast("double").alias("bound"),
    )
    found = (
        homes.unionByName(looking)
        .repartition("capture_id", "cell")
        .sortWithinPartitions("capture_id", "cell", "looks", "id")
        .mapInPandas(_candidates, NEIGHBOUR_SCHEMA)
    )
    nearer = Window.partitionBy("capture_id", "id").orderBy("distance", "neighbour")
    before = F.coalesce(F.sum("copies").over(nearer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        found.withColumn("share", F.least("copies", F.col("k") - before))
        .filter(F.col("share") > 0)
        .drop("copies")
    )


def local_outlier_factor(
    rows: DataFrame, chunks: DataFrame, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(capture_id, w, lof) for every window."""
    points = scratch_table(merge_equal_rows(rows), "lof-points")
    near = scratch_table(nearest_neighbours(points, chunks, cell_rows), "lof-neighbours")
    key = ["capture_id", "id"]
    k_distance = near.groupBy(*key).agg(F.max("distance").alias("k_distance"))
    reach = near.join(
        k_distance.select("capture_id", F.col("id").alias("neighbour"), "k_distance"),
        ["capture_id", "neighbour"],
    ).withColumn("reach", F.greatest("k_distance", "distance"))
    density = reach.groupBy(*key).agg(
        (
            F.lit(1.0)
            / (F.sum(F.col("reach") * F.col("share")) / F.sum("share") + F.lit(TINY))
        ).alias("density")
    )
    density = scratch_table(density, "lof-density")
    around = near.join(
        density.select(
            "capture_id", F.col("id").alias("neighbour"), F.col("density").alias("near_density")
        ),
        ["capture_id", "neighbour"],
    )
    factor = (
        around.groupBy(*key)
        .agg(
            (F.sum(F.col("near_density") * F.col("share")) / F.sum("share")).alias("near_density")
        )
        .join(density, key)
        .select(*key, (F.col("near_density") / F.col("density")).alias("lof"))
    )
    by_vector = points.select("capture_id", "id", "x").join(factor, key)
    return rows.select("capture_id", "w", "x").join(by_vector, ["capture_id", "x"]).select(
        "capture_id", "w", "lof"
    )
