"""What the three models share: scaled rows, models next to rows, exact quantiles."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.operators.features import FEATURE_NAMES
from wirelens.session import small_side

MIN_WINDOWS = 5
CHUNK_ROWS = 20_000
EXACT_ROWS = 10_000


def feature_stats(features: DataFrame) -> DataFrame:
    """Per capture with enough windows: `n`, and mean and population deviation per feature."""
    return (
        features.groupBy("capture_id")
        .agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"{c}_mean") for c in FEATURE_NAMES],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in FEATURE_NAMES],
        )
        .filter(F.col("n") >= MIN_WINDOWS)
    )


def _is_constant(name: str) -> Column:
    # A deviation that is rounding noise of the mean is no deviation.
    return F.col(f"{name}_std") <= F.abs(f"{name}_mean") * 1e-12


def scaled_rows(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(capture_id, w, n, chunk, gamma, x): standardised features; constant ones become 0.

    `chunk` splits a capture into parts of bounded size. `gamma` is one over the number of features
    times the overall variance, which after scaling is one over the number of varying features.
    """
    x = [
        F.when(_is_constant(c), 0.0).otherwise(
            (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        )
        for c in FEATURE_NAMES
    ]
    varying = sum((F.when(_is_constant(c), 0).otherwise(1) for c in FEATURE_NAMES), F.lit(0))
    chunks = F.ceil(F.col("n") / CHUNK_ROWS)
    return features.join(stats, "capture_id").select(
        "capture_id",
        "w",
        "n",
        F.pmod(F.xxhash64("w"), chunks).cast("int").alias("chunk"),
        (F.lit(1.0) / F.greatest(varying, F.lit(1))).alias("gamma"),
        F.array(*x).alias("x"),
    )


def beside_models(
    rows: DataFrame, models: DataFrame, fn: Callable, schema: str, chunk_counts: DataFrame
) -> DataFrame:
    """Run `fn(rows, models)` per chunk of a capture, with the capture's model rows next to it.

    Rows of a capture are spread over chunks of bounded size, and its model rows are repeated once
    per chunk, so neither a large capture nor many captures end up in one place.
    """
    spread = models.join(small_side(chunk_counts), "capture_id").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    spread = spread.drop("chunks")
    spread = spread.toDF(*spread.columns)  # models may stem from the same rows
    key = ["capture_id", "chunk"]
    return (
        rows.groupBy(*key)
        .cogroup(spread.groupBy(*key))
        .applyInPandas(fn, schema)
    )


def chunk_counts(stats: DataFrame) -> DataFrame:
    return stats.select(
        "capture_id", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks")
    )


def exact_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """Linearly interpolated quantile per capture: (capture_id, quantile).

    An approximate quantile with a guaranteed rank error brackets the wanted ranks; only the
    distinct values inside the bracket are ordered, offset by the count below it.
    """
    band = 5e-4
    bounds = rows.groupBy("capture_id").agg(
        F.count(value).alias("total"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.percentile_approx(value, [max(0.0, q - band), min(1.0, q + band)], 10_000).alias("near"),
    )
    few = F.col("total") <= EXACT_ROWS
    position = (F.col("total") - 1) * F.lit(q)
    brackets = small_side(
        bounds.select(
            "capture_id",
            F.when(few, F.col("lo")).otherwise(F.col("near")[0]).alias("lo"),
            F.when(few, F.col("hi")).otherwise(F.col("near")[1]).alias("hi"),
            F.floor(position).alias("rank_lo"),
            F.least(F.floor(position) + 1, F.col("total") - 1).alias("rank_hi"),
            (position - F.floor(position)).alias("fraction"),
        )
    )
    placed = rows.select("capture_id", F.col(value).alias("v")).join(brackets, "capture_id")
    # Values below the bracket collapse into one row per capture.
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    counted = (
        placed.filter(F.col("v") <= F.col("hi"))
        .groupBy("capture_id", "rank_lo", "rank_hi", "fraction", inside.alias("v"))
        .agg(F.count("*").alias("c"))
    )
    upto = F.sum("c").over(Window.partitionBy("capture_id").orderBy(F.col("v").asc_nulls_first()))
    ranked = counted.withColumn("upto", upto)

    def at(rank: str) -> Column:
        here = (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank))
        return F.max(F.when(here, F.col("v")))

    return (
        ranked.groupBy("capture_id")
        .agg(at("rank_lo").alias("a"), at("rank_hi").alias("b"), F.max("fraction").alias("f"))
        .select("capture_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))
    )
