"""The vote: planted outliers, exact parts against numpy, repeatability."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from made_rows import T0
from wirelens.operators.anomaly import ensemble, lof, prepare, svm
from wirelens.operators.features import FEATURE_NAMES
from wirelens.session import scratch_table

SCHEMA = "capture_id string, w bigint, window_start_us bigint, " + ", ".join(
    f"{c} double" for c in FEATURE_NAMES
)


def windows(spark, x, capture="c"):
    rows = [(capture, i, T0 + i * 60_000_000, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def planted():
    """Twenty windows around 5, two of them at 50 and 40 in every feature."""
    x = np.abs(np.random.RandomState(42).normal(5.0, 1.0, (20, 18)))
    x[10], x[15] = 50.0, 40.0
    return x


def test_planted_outliers_are_found(spark, planted):
    found = ensemble.detect_anomalies(windows(spark, planted), sensitivity=0.1).collect()
    assert {10, 15} & {r["w"] for r in found}
    for r in found:
        assert 0 <= r["anomaly_score"] <= 1.0001
        assert len(r["contributing"]) == 3 and "x " in r["contributing"][0]
        assert r["end_us"] - r["start_us"] == 60_000_000
        assert r["agreement"] in ("2 of 3", "3 of 3")


def test_forest_ranks_planted_outliers_first(spark, planted):
    rows = ensemble.model_scores(windows(spark, planted), sensitivity=0.1).collect()
    order = [r["w"] for r in sorted(rows, key=lambda r: r["forest_score"])]
    assert {10, 15} in (set(order[:2]), set(order[-2:]))


def test_few_windows_give_nothing(spark, planted):
    assert ensemble.detect_anomalies(windows(spark, planted[:4])).count() == 0


def test_uniform_windows_give_at_most_two(spark):
    assert ensemble.detect_anomalies(windows(spark, np.ones((30, 18)))).count() <= 2


def test_sensitivity_bounds(spark, planted):
    with pytest.raises(ValueError):
        ensemble.detect_anomalies(windows(spark, planted), sensitivity=0.5)


def test_scores_are_repeatable_and_per_capture(spark, planted):
    one = windows(spark, planted)
    two = one.unionByName(windows(spark, planted * 2 + 1, "d")).repartition(5)
    a = {r["w"]: r for r in ensemble.model_scores(one).collect()}
    b = {r["w"]: r for r in ensemble.model_scores(two).filter("capture_id = 'c'").collect()}
    for w, row in a.items():
        for name in ("forest_score", "lof", "svm_score"):
            assert row[name] == pytest.approx(b[w][name], rel=1e-9)


@pytest.mark.parametrize("n", [7, 500, 25_000])
@pytest.mark.parametrize("q", [0.05, 0.95])
def test_exact_quantile(spark, n, q):
    values = np.round(np.random.default_rng(n).normal(size=n), 3)  # with ties
    rows = spark.createDataFrame([("c", float(v)) for v in values], "capture_id string, v double")
    got = prepare.exact_quantile(rows, "v", q).first()["quantile"]
    assert got == pytest.approx(np.quantile(values, q), abs=1e-12)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kd[near]).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def test_outlier_factor_over_many_cells_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1, (100, 18)) for c in (0, 12, 30)])
    x[50:80] = x[0]  # a group of equal windows
    frame = windows(spark, x)
    stats = prepare.feature_stats(frame)
    rows = scratch_table(prepare.scaled_rows(frame, stats), "scaled")
    chunks = prepare.chunk_counts(stats)
    got = {r["w"]: r["lof"] for r in lof.local_outlier_factor(rows, chunks, cell_rows=20).collect()}
    scaled = (x - x.mean(0)) / x.std(0)
    expected = brute_lof(scaled, 20)
    assert len(got) == 300
    for w in range(300):
        assert got[w] == pytest.approx(expected[w], rel=1e-6)


def test_votes_and_normalised_score(spark):
    scores = spark.createDataFrame(
        [("c", i, 0.4 + i / 100, 1.0 + i, 10.0 - i) for i in range(21)],
        "capture_id string, w bigint, forest_score double, lof double, svm_score double",
    )
    votes = {r["w"]: r for r in ensemble.model_votes(scores, 0.05).collect()}
    assert [votes[20][m] for m in ensemble.MODELS] == [-1, -1, -1]
    assert [votes[19][m] for m in ensemble.MODELS] == [1, 1, 1]
    assert votes[20]["anomaly_score"] == pytest.approx(1.0)
    assert votes[0]["anomaly_score"] == pytest.approx(0.0, abs=1e-8)


def test_one_class_model_does_not_depend_on_chunks(spark, monkeypatch):
    x = np.random.RandomState(7).normal(0.0, 1.0, (120, 18))
    table = scratch_table(windows(spark, x), "svm-windows")
    found = []
    for chunk_rows in (1000, 25):
        monkeypatch.setattr(prepare, "CHUNK_ROWS", chunk_rows)
        stats = scratch_table(prepare.feature_stats(table), "svm-stats")
        rows = scratch_table(prepare.scaled_rows(table, stats), "svm-rows")
        model = scratch_table(svm.train(rows, 0.1, chunk_rows), "svm-model")
        scores = svm.score_svm(rows, model, prepare.chunk_counts(stats)).orderBy("w").collect()
        found.append([r["svm_score"] for r in scores])
    assert len(found[0]) == 120
    np.testing.assert_allclose(found[0], found[1], rtol=1e-6)


def test_several_large_captures_are_fitted_over_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(svm, "AT_ONCE", 2)
    random = np.random.RandomState(5)
    parts = {c: random.normal(0.0, 1.0 + i, (90, 18)) for i, c in enumerate("abcd")}
    table = windows(spark, parts["a"]).limit(0)
    for capture, x in parts.items():
        table = table.union(windows(spark, x[: 8 if capture == "d" else 90]).withColumn("capture_id", F.lit(capture)))
    table = scratch_table(table, "svm-windows")
    rows = scratch_table(prepare.scaled_rows(table, prepare.feature_stats(table)), "svm-rows")
    together = {(r.capture_id, r.component): r.weight for r in svm.train(rows, 0.1, 20).collect()}
    alone = {(r.capture_id, r.component): r.weight for r in svm.train(rows, 0.1).collect()}
    assert together.keys() == alone.keys() and len(alone) == 4 * svm.COMPONENTS
    for key, weight in alone.items():
        assert together[key] == pytest.approx(weight, abs=1e-6)


def test_the_solution_has_the_least_norm():
    """Against all corners' means by long conditional gradient in the features' space."""
    z = svm.fourier(np.random.RandomState(2).normal(0.0, 1.0, (200, 18)), 1 / 18)
    enough, found = 20, svm.Solution()
    while not found.done:
        seen = svm.Histogram(z, found.weights, enough)
        found.add(svm.lowest_mean(seen.bins, seen.counts, seen.sums, enough))
    weights = z.mean(axis=0)
    for step in range(5000):
        low = np.argpartition(z @ weights, enough - 1)[:enough]
        weights = weights + (z[low].mean(axis=0) - weights) * 2 / (step + 2)
    assert found.weights @ found.weights == pytest.approx(weights @ weights, rel=0.02)
    assert np.corrcoef(z @ weights, z @ found.weights)[0, 1] > 0.98


def test_one_class_model_is_near_the_exact_dual(spark):
    """Against the dual solved to the end: minimise a'Ka over sum(a) = 1, 0 <= a <= 1 / (nu n)."""
    x = np.random.RandomState(3).normal(0.0, 1.0, (60, 18))
    nu, n = 0.1, len(x)
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-((scaled[:, None] - scaled[None]) ** 2).sum(axis=2) / 18)
    a = np.full(n, 1 / n)
    for step in range(20_000):
        slope = kernel @ a
        low = np.argsort(slope)[: int(np.ceil(nu * n))]
        target = np.zeros(n)
        target[low] = 1 / len(low)
        a += (target - a) * 2 / (step + 2)
    exact = kernel @ a
    table = scratch_table(windows(spark, x), "svm-windows")
    stats = scratch_table(prepare.feature_stats(table), "svm-stats")
    rows = scratch_table(prepare.scaled_rows(table, stats), "svm-rows")
    model = scratch_table(svm.train(rows, nu), "svm-model")
    got = [r["svm_score"] for r in svm.score_svm(rows, model, prepare.chunk_counts(stats)).orderBy("w").collect()]
    assert np.corrcoef(exact, got)[0, 1] > 0.5
    assert len(set(np.argsort(exact)[:6]) & set(np.argsort(got)[:12])) >= 3


def test_distances_to_many_rows_take_little_memory():
    tracemalloc.start()
    try:
        lof._distances(np.zeros((64, 18)), np.ones((40_000, 18)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6  # 20 MB of them are the result


def test_few_cells_are_visited_when_some_windows_lie_far_out():
    rng = np.random.default_rng(7)
    x = np.zeros((6000, 18))
    x[:, :3] = rng.normal(0, 1, (6000, 3)) * rng.pareto(1.5, (6000, 1))
    points = pd.DataFrame(
        {"capture_id": "c", "chunk": 0, "id": np.arange(6000), "weight": 1, "k": 20, "x": list(x)}
    )
    tree = lof._grow(points[["capture_id", "x"]].assign(leaf=100.0))
    placed = lof._to_cells(points, tree)
    assert placed.groupby("cell").size().max() < 200
    parts = [part for _, part in placed.groupby("cell")]
    boxes = pd.DataFrame(
        [(p["cell"].iloc[0], np.vstack(p["x"]).min(axis=0), np.vstack(p["x"]).max(axis=0)) for p in parts],
        columns=["cell", "low", "high"],
    )
    visits = lof._visits(pd.concat([lof._bounds(p) for p in parts]), boxes)
    assert len(boxes) > 30 and visits["cells"].map(len).mean() < 8
    assert visits["cells"].map(len).sum() >= 6000


def test_outlier_factor_of_heavy_tailed_windows_is_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 18)) * rng.pareto(1.0, (400, 1))
    x[:, 5] = np.round(x[:, 5])
    x[:40] = np.round(x[:40])  # some equal rows, and equal distances
    frame = windows(spark, x)
    stats = prepare.feature_stats(frame)
    rows = scratch_table(prepare.scaled_rows(frame, stats), "scaled")
    near = lof.local_outlier_factor(rows, prepare.chunk_counts(stats), cell_rows=10)
    got = {r["w"]: r["lof"] for r in near.collect()}
    expected = brute_lof((x - x.mean(0)) / x.std(0), 20)
    assert [got[w] for w in range(400)] == pytest.approx(expected.tolist(), rel=1e-6)
