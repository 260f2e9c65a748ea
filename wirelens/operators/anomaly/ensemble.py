"""The vote: a window is anomalous when at least two of the three models say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.text import fixed
from wirelens.operators.anomaly import forest, lof, svm
from wirelens.operators.anomaly.prepare import (
    chunk_counts,
    exact_quantile,
    feature_stats,
    scaled_rows,
)
from wirelens.operators.features import FEATURE_NAMES
from wirelens.session import scratch_table, small_side

MODELS = ["isolation_forest", "local_outlier_factor", "one_class_svm"]
MODEL_LABELS = {
    "isolation_forest": "Isolation Forest",
    "local_outlier_factor": "Local Outlier Factor",
    "one_class_svm": "One-Class SVM",
}
SENSITIVITY_RANGE = (0.01, 0.15)
DEFAULT_SENSITIVITY = 0.05
VOTES_NEEDED = 2
TINY = 1e-10


def model_scores(features: DataFrame, sensitivity: float = DEFAULT_SENSITIVITY) -> DataFrame:
    """(capture_id, w, forest_score, lof, svm_score) for captures with at least five windows."""
    stats = small_side(scratch_table(feature_stats(features), "feature-stats"))
    rows = scratch_table(scaled_rows(features, stats), "scaled")
    chunks = chunk_counts(stats)
    trees = forest.grow_forest(rows)
    return (
        forest.score_forest(rows, trees, chunks)
        .join(lof.local_outlier_factor(rows, chunks), ["capture_id", "w"])
        .join(svm.score_svm(rows, svm.train(rows, sensitivity), chunks), ["capture_id", "w"])
    )


def vote(flag: Column) -> Column:
    return F.when(flag, -1).otherwise(1)


def model_votes(scores: DataFrame, sensitivity: float = DEFAULT_SENSITIVITY) -> DataFrame:
    """Votes per window (-1 is anomalous), and the normalised score (1 is most anomalous).

    The forest and the factor flag what lies beyond the `sensitivity` quantile, the SVM what lies
    below its offset.
    """

    def limit(value: str, q: float, name: str) -> DataFrame:
        return small_side(
            exact_quantile(scores, value, q).withColumnRenamed("quantile", name)
        )

    ends = small_side(
        scores.groupBy("capture_id").agg(
            F.min("forest_score").alias("least"), F.max("forest_score").alias("most")
        )
    )
    bounded = (
        scores.join(limit("forest_score", 1 - sensitivity, "forest_limit"), "capture_id")
        .join(limit("lof", 1 - sensitivity, "lof_limit"), "capture_id")
        .join(limit("svm_score", sensitivity, "svm_limit"), "capture_id")
        .join(ends, "capture_id")
    )
    return bounded.select(
        "capture_id",
        "w",
        vote(F.col("forest_score") > F.col("forest_limit")).alias(MODELS[0]),
        vote(F.col("lof") > F.col("lof_limit")).alias(MODELS[1]),
        vote(F.col("svm_score") < F.col("svm_limit")).alias(MODELS[2]),
        normalised_score().alias("anomaly_score"),
    )


def normalised_score() -> Column:
    spread = F.col("most") - F.col("least") + F.lit(TINY)
    return F.lit(1.0) - (F.col("most") - F.col("forest_score")) / spread


def votes_against() -> Column:
    return sum((F.when(F.col(m) == -1, 1).otherwise(0) for m in MODELS), F.lit(0))


def agreement_text() -> Column:
    """How many of the models flagged the window, in words."""
    return F.format_string(f"%d of {len(MODELS)}", votes_against())


def contributing_features(features: DataFrame, stats: DataFrame) -> DataFrame:
    """The three features farthest from their mean, as text; ties go to the later feature."""

    def entry(index: int, name: str) -> Column:
        std = F.when(F.col(f"{name}_std") == 0, TINY).otherwise(F.col(f"{name}_std"))
        z = (F.col(name) - F.col(f"{name}_mean")) / std
        return F.struct(
            F.abs(z).alias("size"), F.lit(index).alias("index"), F.lit(name).alias("name"), z.alias("z")
        )

    entries = F.array(*[entry(i, name) for i, name in enumerate(FEATURE_NAMES)])
    top = F.slice(F.sort_array(entries, asc=False), 1, 3)
    text = F.transform(
        top,
        lambda e: F.concat(
            e["name"],
            F.lit(" ("),
            fixed(e["size"], 1),
            F.when(e["z"] > 0, "x above baseline)").otherwise("x below baseline)"),
        ),
    )
    return features.join(stats, "capture_id").select(
        "capture_id", "w", "window_start_us", text.alias("contributing")
    )


def anomalies_from_votes(
    features: DataFrame, votes: DataFrame, window_seconds: int = 60
) -> DataFrame:
    """Flagged windows with their range, score, votes and contributing features."""
    stats = small_side(feature_stats(features))
    flagged = votes.filter(votes_against() >= VOTES_NEEDED)
    start = F.col("window_start_us")
    return (
        features.join(flagged.select("capture_id", "w"), ["capture_id", "w"], "left_semi")
        .transform(contributing_features, stats)
        .join(flagged, ["capture_id", "w"])
        .select(
            "capture_id",
            "w",
            start.alias("start_us"),
            (start + window_seconds * 1_000_000).alias("end_us"),
            "anomaly_score",
            "contributing",
            F.struct(*MODELS).alias("votes"),
            agreement_text().alias("agreement"),
        )
    )


def detect_anomalies(
    features: DataFrame, window_seconds: int = 60, sensitivity: float = DEFAULT_SENSITIVITY
) -> DataFrame:
    low, high = SENSITIVITY_RANGE
    if not low <= sensitivity <= high:
        raise ValueError(f"sensitivity must be between {low} and {high}")
    scores = scratch_table(model_scores(features, sensitivity), "model-scores")
    votes = scratch_table(model_votes(scores, sensitivity), "model-votes")
    return anomalies_from_votes(features, votes, window_seconds)
