"""One-class SVM with an RBF kernel, approximately, fitted on all windows of a capture.

The kernel is replaced by random Fourier features (Rahimi and Recht, 2007). The dual is then the point of
least norm in a polytope whose corners are means of the share `nu` of rows, and the corner that matters
next is the mean of the rows with the lowest scores. It is found from a histogram of the scores that holds
each bin's number of rows and sum of features. After each corner, the point of least norm among all corners so
far is taken (fully corrective conditional gradient), until the next corner gains next to nothing.

Histograms add up, so captures of any number of windows go the same way: a capture that is one chunk takes its
steps inside one task, larger ones take a pass over their rows for each step, where tasks send a row per bin. The
offset is the exact nu-quantile of all scores. How rows are dealt into chunks doesn't change the model but for
rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.anomaly.prepare import CHUNK_ROWS, beside_models
from wirelens.operators.features import FEATURE_NAMES

COMPONENTS = 256
STEPS = 60
SEED = 42
#: Bins of scores, and the gain, as a share of the squared norm, below which no more steps are taken.
BINS = 4096
LEAST_GAIN = 1e-2
#: Captures of several chunks that are fitted at a time: their corners are in the driver.
AT_ONCE = 16

MODEL_SCHEMA = "capture_id string, component int, weight double"


def fourier(x: np.ndarray, gamma: float, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((len(FEATURE_NAMES), COMPONENTS))
    phases = rng.uniform(0.0, 2.0 * np.pi, COMPONENTS)
    return np.sqrt(2.0 / COMPONENTS) * np.cos(np.sqrt(2.0 * gamma) * (x @ directions) + phases)


class Histogram:
    """Rows and sums of features by bin of scores; the lowest bins that hold `enough` rows."""

    def __init__(self, z: np.ndarray, weights: np.ndarray, enough: int):
        bound = np.sqrt(2.0 * float(weights @ weights)) or 1.0  # features have a norm of at most the root of 2
        at = np.clip((z @ weights + bound) / (2 * bound) * BINS, 0, BINS - 1).astype(np.int64)
        counts = np.bincount(at, minlength=BINS)
        last = int(np.searchsorted(np.cumsum(counts), enough)) + 1
        low = np.flatnonzero(at < last)
        order = low[np.argsort(at[low], kind="stable")]
        self.bins, heads = np.unique(at[order], return_index=True)
        self.counts = counts[self.bins]
        self.sums = np.add.reduceat(z[order], heads, axis=0) if len(order) else np.zeros((0, COMPONENTS))


def lowest_mean(bins: np.ndarray, counts: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Mean features of the `n` lowest rows; of the last bin a part, by its mean."""
    order = np.argsort(bins, kind="stable")
    counts, sums = counts[order], sums[order]
    taken = np.clip(n - (np.cumsum(counts) - counts), 0, counts) / np.maximum(counts, 1)
    return (taken[:, None] * sums).sum(axis=0) / n


class Solution:
    """Corners so far, and the point of least norm among them."""

    def __init__(self):
        self.corners = np.zeros((0, COMPONENTS))
        self.shares = np.zeros(0)
        self.weights = np.zeros(COMPONENTS)
        self.done = False

    def add(self, corner: np.ndarray) -> None:
        norm = float(self.weights @ self.weights)
        if len(self.shares) and norm - float(self.weights @ corner) <= LEAST_GAIN * norm:
            self.done = True
            return
        self.corners = np.vstack([self.corners, corner])
        self.shares = np.append(self.shares, 0.0 if len(self.shares) else 1.0)
        products = self.corners @ self.corners.T
        for _ in range(20 * len(self.shares) ** 2):  # pairwise steps: from the worst share to the best corner
            slope = products @ self.shares
            best = int(slope.argmin())
            worst = int(np.where(self.shares > 0, slope, -np.inf).argmax())
            gain = slope[worst] - slope[best]
            if gain <= 1e-6 * LEAST_GAIN * max(norm, 1e-12):
                break
            curve = products[worst, worst] + products[best, best] - 2 * products[worst, best]
            step = min(self.shares[worst], gain / curve if curve > 0 else self.shares[worst])
            self.shares[worst] -= step
            self.shares[best] += step
        self.weights = self.shares @ self.corners
        self.done = len(self.shares) >= STEPS

    def model(self, capture_id: str) -> pd.DataFrame:
        return pd.DataFrame(
            {"capture_id": capture_id, "component": np.arange(COMPONENTS, dtype=np.int32), "weight": self.weights}
        )


def lowest_rows(n: int, nu: float) -> int:
    return max(1, int(np.ceil(nu * n)))


def _features(pdf: pd.DataFrame) -> np.ndarray:
    return fourier(np.vstack(pdf["x"].to_numpy()), float(pdf["gamma"].iloc[0]))


def _solve(pdf: pd.DataFrame, nu: float) -> pd.DataFrame:
    """A capture that is one chunk."""
    z, enough, found = _features(pdf.sort_values("w")), lowest_rows(len(pdf), nu), Solution()
    while not found.done:
        seen = Histogram(z, found.weights, enough)
        found.add(lowest_mean(seen.bins, seen.counts, seen.sums, enough))
    return found.model(pdf["capture_id"].iloc[0])


def _solve_together(rows: DataFrame, sizes: dict[str, int], nu: float) -> list[pd.DataFrame]:
    """Captures of several chunks: a pass over their rows gives each its next corner."""
    found = {capture: Solution() for capture in sizes}
    enough = {capture: lowest_rows(n, nu) for capture, n in sizes.items()}
    while any(not one.done for one in found.values()):
        weights = {capture: one.weights for capture, one in found.items() if not one.done}

        def count(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for capture, part in pdf.groupby("capture_id"):
                    seen = Histogram(_features(part), weights[capture], enough[capture])
                    yield pd.DataFrame(
                        {"capture_id": capture, "bin": seen.bins, "n": seen.counts, "sums": list(seen.sums)}
                    )

        counted = (
            rows.filter(F.col("capture_id").isin(*weights))
            .mapInPandas(count, "capture_id string, bin long, n long, sums array<double>")
            .groupBy("capture_id", "bin")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(COMPONENTS)]).alias("sums"))
        )
        for capture, part in counted.toPandas().groupby("capture_id"):  # at most `BINS` rows each
            sums = np.vstack(part["sums"].to_numpy())
            found[capture].add(lowest_mean(part["bin"].to_numpy(), part["n"].to_numpy(), sums, enough[capture]))
    return [one.model(capture) for capture, one in found.items()]


def train(rows: DataFrame, nu: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(capture_id, component, weight): one solution per capture, over all its rows."""
    columns = ["capture_id", "w", "n", "x", "gamma"]
    small = (
        rows.select(*columns)
        .filter(F.col("n") <= chunk_rows)
        .groupBy("capture_id")
        .applyInPandas(partial(_solve, nu=nu), MODEL_SCHEMA)
    )
    large = rows.select(*columns).filter(F.col("n") > chunk_rows)
    captures = large.groupBy("capture_id").agg(F.max("n").alias("n")).orderBy("capture_id")
    models, last = small, ""
    while True:
        some = captures.filter(F.col("capture_id") > last).limit(AT_ONCE).collect()
        if not some:
            return models
        sizes = {r.capture_id: r.n for r in some}
        solved = pd.concat(_solve_together(large, sizes, nu))
        models = models.unionByName(rows.sparkSession.createDataFrame(solved, MODEL_SCHEMA))
        last = some[-1].capture_id


def _apply(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or model.empty:
        return pd.DataFrame({"capture_id": [], "w": [], "svm_score": []})
    weights = model.sort_values("component")["weight"].to_numpy()
    return pd.DataFrame(
        {"capture_id": rows["capture_id"], "w": rows["w"], "svm_score": _features(rows) @ weights}
    )


def score_svm(rows: DataFrame, model: DataFrame, chunks: DataFrame) -> DataFrame:
    """(capture_id, w, svm_score); low is outside."""
    return beside_models(
        rows.select("capture_id", "chunk", "w", "x", "gamma"),
        model,
        _apply,
        "capture_id string, w bigint, svm_score double",
        chunks,
    )
