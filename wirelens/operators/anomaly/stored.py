"""Trained models that are kept, by version, and applied to windows they haven't seen.

`train` fits the scaler, the isolation forest and the one-class SVM on the windows of past captures and works out
from what scores on a window counts as anomalous. `publish` appends the models to a table as its next version: one
row per model, with forest nodes, weights, means, deviations and limits as arrays. `load` reads a version back.
`score` applies it to any windows, in batch or in a stream's batches, with the same result.

The outlier factor has no stored form, since a window's factor needs all others; two models vote.

By default there is one model over all captures given, for captures to come; with `by_capture` there is one for
each, for sensors that keep their `capture_id`. Windows without a model of theirs get null scores and votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.operators.anomaly import forest, svm
from wirelens.operators.anomaly.ensemble import DEFAULT_SENSITIVITY, TINY
from wirelens.operators.anomaly.prepare import (
    CHUNK_ROWS,
    beside_models,
    chunk_counts,
    exact_quantile,
    feature_stats,
    scaled_rows,
)
from wirelens.operators.features import FEATURE_NAMES
from wirelens.session import scratch_table, small_side

EVERY = "*"
KEY = ["capture_id", "window_start_us"]
SCORES = (
    "forest_score double, svm_score double, anomaly_score double, isolation_forest int, one_class_svm int"
)


@dataclass
class Models:
    """One version: `rows` has a row per model; `capture_id` is `EVERY` for one over all captures."""

    rows: DataFrame
    version: int | None
    by_capture: bool


def train(
    features: DataFrame, sensitivity: float = DEFAULT_SENSITIVITY, by_capture: bool = False
) -> Models:
    """Models of (capture_id, window_start_us, features) rows; captures need five windows, as in the vote."""
    owner = F.col("capture_id") if by_capture else F.lit(EVERY)
    # Windows of several captures meet in one model, so their own numbers would repeat.
    named = features.select(
        owner.alias("capture_id"), F.xxhash64(*KEY).alias("w"), *FEATURE_NAMES
    )
    stats = scratch_table(feature_stats(named), "model-stats")
    rows = scratch_table(scaled_rows(named, small_side(stats)), "model-rows")
    chunks = chunk_counts(stats)
    trees = scratch_table(forest.grow_forest(rows), "model-trees")
    weights = scratch_table(svm.train(rows, sensitivity), "model-weights")
    scores = scratch_table(
        forest.score_forest(rows, trees, chunks).join(
            svm.score_svm(rows, weights, chunks), ["capture_id", "w"]
        ),
        "model-scores",
    )
    ends = scores.groupBy("capture_id").agg(
        F.min("forest_score").alias("least"), F.max("forest_score").alias("most")
    )
    nodes = ["tree", "sample", "feature", "cut", "lower", "upper", "length"]
    models = (
        stats.select(
            "capture_id",
            "n",
            F.array(*[f"{c}_mean" for c in FEATURE_NAMES]).alias("means"),
            F.array(*[f"{c}_std" for c in FEATURE_NAMES]).alias("deviations"),
            F.lit(sensitivity).alias("sensitivity"),
        )
        .join(rows.groupBy("capture_id").agg(F.min("gamma").alias("gamma")), "capture_id")
        .join(
            trees.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct(*nodes))).alias("trees")),
            "capture_id",
        )
        .join(
            weights.groupBy("capture_id").agg(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("component", "weight"))), lambda w: w["weight"]
                ).alias("weights")
            ),
            "capture_id",
        )
        .join(ends, "capture_id")
        .join(
            exact_quantile(scores, "forest_score", 1 - sensitivity).withColumnRenamed("quantile", "forest_limit"),
            "capture_id",
        )
        .join(
            exact_quantile(scores, "svm_score", sensitivity).withColumnRenamed("quantile", "svm_limit"),
            "capture_id",
        )
    )
    return Models(scratch_table(models, "models"), None, by_capture)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, by_capture, models, windows) of all that is published."""
    return (
        spark.read.parquet(path)
        .groupBy("version", "by_capture")
        .agg(F.count("*").alias("models"), F.sum("n").alias("windows"))
    )


def publish(models: Models, path: str) -> int:
    """Append the models to the table at `path` as its next version, which appears as a whole; gives its number.

    Trainers take turns: who publishes is one job.
    """
    spark = models.rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    last = spark.read.parquet(path).agg(F.max("version")).head()[0] if exists else None
    version = (last or 0) + 1
    rows = models.rows.withColumns(
        {"version": F.lit(version), "by_capture": F.lit(models.by_capture)}
    )
    rows.write.mode("append").parquet(path)
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Models:
    """A published version, the latest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).head()[0]
    rows = table.filter(F.col("version") == version)
    kinds = [r.by_capture for r in rows.select("by_capture").distinct().collect()]
    if not kinds:
        raise ValueError(f"no version {version} of models in {path}")
    return Models(rows.drop("version", "by_capture"), version, kinds[0])


def _apply(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    """Scores and votes of one chunk of windows by its model."""
    out = rows[["real_capture", "window_start_us"]].rename(columns={"real_capture": "capture_id"})
    if rows.empty:
        return out.assign(**{c.split()[0]: [] for c in SCORES.split(", ")})
    if models.empty:
        return out.assign(**{c.split()[0]: None for c in SCORES.split(", ")})
    model = models.iloc[0]
    means, deviations = np.array(model["means"]), np.array(model["deviations"])
    constant = deviations <= np.abs(means) * 1e-12
    x = (rows[FEATURE_NAMES].to_numpy(float) - means) / np.where(constant, 1.0, deviations)
    x[:, constant] = 0.0
    scaled = pd.DataFrame({"capture_id": rows["capture_id"], "w": 0, "x": list(x), "gamma": model["gamma"]})
    trees = pd.DataFrame([tree if isinstance(tree, dict) else tree.asDict() for tree in model["trees"]])
    weights = pd.DataFrame({"component": np.arange(len(model["weights"])), "weight": model["weights"]})
    of_forest = forest._score(scaled, trees)["forest_score"].to_numpy()
    of_svm = svm._apply(scaled, weights)["svm_score"].to_numpy()
    return out.assign(
        forest_score=of_forest,
        svm_score=of_svm,
        anomaly_score=1.0 - (model["most"] - of_forest) / (model["most"] - model["least"] + TINY),
        isolation_forest=np.where(of_forest > model["forest_limit"], -1, 1),
        one_class_svm=np.where(of_svm < model["svm_limit"], -1, 1),
    )


def score(features: DataFrame, models: Models) -> DataFrame:
    """(capture_id, window_start_us, scores, votes, version) of all windows; -1 is a vote for anomalous.

    A window's scores depend on it and its model only. An `anomaly_score` above 1 is beyond all that the model saw.
    """
    owner = F.col("capture_id") if models.by_capture else F.lit(EVERY)
    rows = features.select(
        owner.alias("capture_id"),
        F.col("capture_id").alias("real_capture"),
        "window_start_us",
        *FEATURE_NAMES,
    )
    counts = rows.groupBy("capture_id").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    counts = small_side(counts)
    dealt = rows.join(counts, "capture_id").withColumn(
        "chunk", F.pmod(F.xxhash64("real_capture", "window_start_us"), F.col("chunks")).cast("int")
    )
    found = beside_models(
        dealt.drop("chunks"),
        models.rows,
        _apply,
        f"capture_id string, window_start_us bigint, {SCORES}",
        counts,
    )
    return found.withColumn("version", F.lit(models.version).cast("int"))
