"""Scoring windows of a stream with stored models, each window written once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelens.operators.anomaly import stored
from wirelens.operators.features import FEATURE_NAMES
from wirelens.session import scratch_folder, scratch_table
from wirelens.streaming.sources import closed, start_batches


def score_batches(models: stored.Models, path: str) -> Callable[[DataFrame, int], None]:
    """What writes the scores of a batch of windows (capture_id, window_start, features) under `path`.

    Every batch has a folder of its own, named by its number, that is replaced as a whole. A batch that
    is run again after a failure or a restart thus leaves its windows once. One checkpoint goes with one `path`.
    The batch is written down first, as scoring reads it twice and each reading would run the stream's state again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        windows = batch.withColumn("window_start_us", F.unix_micros("window_start"))
        windows = scratch_table(windows.select(*stored.KEY, *FEATURE_NAMES), "windows")
        stored.score(windows, models).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def start_scoring(
    features: DataFrame, models: stored.Models, path: str, checkpoint: str
) -> StreamingQuery:
    """Score the windows of a feature stream as they close; reads by `read_scores`."""
    return start_batches(features, score_batches(models, path), checkpoint, mode="append")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    schema = f"capture_id string, window_start_us bigint, {stored.SCORES}, version int, epoch int"
    return spark.read.schema(schema).parquet(path).drop("epoch")


def replay_scores(
    spark: SparkSession, make: Callable[[DataFrame], DataFrame], models: stored.Models
) -> DataFrame:
    """Scores of all windows of the feature stream `make(closing)` over what has landed."""
    root = f"{scratch_folder(spark)}/scores-{uuid.uuid4().hex}"
    closed(
        spark, make, f"{root}/closing",
        lambda df: start_scoring(df, models, f"{root}/rows", f"{root}/checkpoint"),
    )
    return read_scores(spark, f"{root}/rows")
