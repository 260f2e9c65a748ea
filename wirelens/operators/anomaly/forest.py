"""Isolation forest (Liu, Ting and Zhou, 2008): trees built in parallel, rows scored in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.operators.anomaly.prepare import beside_models

TREES = 200
SAMPLE = 256
SEED = 42


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def tree_samples(rows: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Up to 256 rows per tree, chosen by a hash of (seed, tree, window) without replacement."""
    chance = F.lit(SAMPLE * 1.6) / F.col("n")
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(
            t.alias("tree"),
            (F.pmod(F.xxhash64(F.lit(seed), t, F.col("w")), F.lit(1 << 40)) / float(1 << 40)).alias(
                "u"
            ),
        ),
    )
    picked = rows.select(
        "capture_id", "w", "x", "n", F.explode(F.filter(draws, lambda d: d["u"] < chance)).alias("d")
    ).select("capture_id", "w", "x", "d.tree", "d.u")
    order = Window.partitionBy("capture_id", "tree").orderBy("u", "w")
    return (
        picked.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= SAMPLE)
        .drop("place", "u")
    )


TREE_SCHEMA = (
    "capture_id string, tree int, sample int, feature array<int>, cut array<double>, "
    "lower array<int>, upper array<int>, length array<double>"
)


def _build_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("w")
    tree = int(pdf["tree"].iloc[0])
    x = np.vstack(pdf["x"].to_numpy())
    rng = np.random.default_rng([SEED, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    feature, cut, lower, upper, length = [], [], [], [], []

    def node(members: np.ndarray, depth: int) -> int:
        index = len(feature)
        for column in (feature, lower, upper):
            column.append(-1)
        cut.append(0.0)
        length.append(depth + float(average_path(len(members))))
        if depth < limit and len(members) > 1:
            part = x[members]
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if varying.size:
                f = int(rng.choice(varying))
                value = float(rng.uniform(low[f], high[f]))
                below = part[:, f] <= value
                if below.any() and not below.all():
                    feature[index], cut[index] = f, value
                    lower[index] = node(members[below], depth + 1)
                    upper[index] = node(members[~below], depth + 1)
        return index

    node(np.arange(len(x)), 0)
    return pd.DataFrame(
        {
            "capture_id": [pdf["capture_id"].iloc[0]],
            "tree": [tree],
            "sample": [len(x)],
            "feature": [feature],
            "cut": [cut],
            "lower": [lower],
            "upper": [upper],
            "length": [length],
        }
    )


def grow_forest(rows: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """One row per (capture, tree) with its nodes as arrays."""
    return (
        tree_samples(rows, trees, seed)
        .groupBy("capture_id", "tree")
        .applyInPandas(_build_tree, TREE_SCHEMA)
    )


def _score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or forest.empty:
        return pd.DataFrame({"capture_id": [], "w": [], "forest_score": []})
    x = np.vstack(rows["x"].to_numpy())
    everyone = np.arange(len(x))
    total = np.zeros(len(x))
    for tree in forest.sort_values("tree").itertuples():
        feature, cut = np.asarray(tree.feature), np.asarray(tree.cut)
        lower, upper = np.asarray(tree.lower), np.asarray(tree.upper)
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            go_low = x[everyone, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go_low, lower[at], upper[at]), at)
        total += np.asarray(tree.length)[at]
    scale = len(forest) * float(average_path(int(forest["sample"].max())))
    return pd.DataFrame(
        {
            "capture_id": rows["capture_id"],
            "w": rows["w"],
            "forest_score": np.exp2(-total / scale) if scale else np.ones(len(x)),
        }
    )


def score_forest(rows: DataFrame, forest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(capture_id, w, forest_score); near 1 is easy to isolate."""
    return beside_models(
        rows.select("capture_id", "chunk", "w", "x"),
        forest,
        _score,
        "capture_id string, w bigint, forest_score double",
        chunks,
    )
