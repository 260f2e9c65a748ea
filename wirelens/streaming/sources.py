"""Streams of packets and log entries from landing folders, and running them to a table.

A bounded run (`run_available`) takes what has landed and ends; `max_files` bounds each batch. Rows
later than the watermark are dropped and counted (`late_rows`).

What the watermark hasn't passed when a bounded run ends stays in the state, for the next run. A replay
(`replay`) is a run after which nothing more comes: a closing row, far in the future and of no key, then moves
the watermark past all windows, sessions and waiting events, and their results are given out too.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wirelens.operators.logs import parse_lines
from wirelens.schemas import PACKETS, with_packet_defaults
from wirelens.session import scratch_folder

LATENESS = "2 minutes"
#: The closing row's time, 2200-01-01: later than any event, and within what pandas can express.
CLOSING_US = 7_258_118_400_000_000


def packet_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    reader = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", max_files)
    return with_packet_defaults(reader.format(fmt).load(path))


def log_line_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(capture_id, source_file, seq, line) of text files; `seq` is the place of the line's part in its file."""
    file = F.col("_metadata.file_path")
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(path)
        .select(
            file.alias("capture_id"),
            file.alias("source_file"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"), F.lit(None).cast("bigint").alias("line")
            ).alias("seq"),
            F.col("value").alias("line"),
        )
    )


def log_stream(
    spark: SparkSession,
    path: str,
    *,
    year: int,
    tz: str = "UTC",
    capture_id: str | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """Log entries as they land; each line is read by its own format. Syslog times carry no year, so it is asked for."""
    lines = log_line_stream(spark, path, max_files)
    if capture_id is not None:
        lines = lines.withColumn("capture_id", F.lit(capture_id))
    return parse_lines(lines, year=year, tz=tz, per_line=True)


def timed(df: DataFrame, lateness: str = LATENESS, closing: DataFrame | None = None) -> DataFrame:
    """`ts` as event time with a watermark; `closing` are the closing rows of a replay, which have no key."""
    if closing is not None:
        df = df.unionByName(closing, allowMissingColumns=True)
    return df.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)


def start(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options: str
) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").options(**options)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def start_batches(df: DataFrame, write, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand every micro-batch to `write(batch, epoch)`, for sinks that replace rows."""
    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over everything that has landed and read back what it wrote."""
    spark = df.sparkSession
    root = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = start(df, f"{root}/rows", f"{root}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


def replay(spark: SparkSession, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run the stream `make(closing)` over everything that has landed, close it, and read back what it wrote.

    The closing row lands in a folder of its own when all else has been taken; the same query goes on with it.
    """
    root = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df = closed(spark, make, f"{root}/closing", lambda df: start(df, f"{root}/rows", f"{root}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


def closed(
    spark: SparkSession,
    make: Callable[[DataFrame], DataFrame],
    folder: str,
    begin: Callable[[DataFrame], StreamingQuery],
) -> DataFrame:
    """Run `make(closing)` by `begin` to its end, then once more with a closing row in `folder`; gives the stream."""
    spark.createDataFrame([], "ts_us bigint").write.parquet(folder)
    df = make(spark.readStream.schema("ts_us bigint").parquet(folder))
    begin(df).awaitTermination()
    spark.createDataFrame([(CLOSING_US,)], "ts_us bigint").write.mode("append").parquet(folder)
    begin(df).awaitTermination()
    return df


def stop_early(query: StreamingQuery) -> None:
    """End a running stream after its current batch; a restart goes on from the checkpoint."""
    query.stop()


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped by the watermark, in the progress reports that the query still keeps.

    A long-running query forgets old reports; `LateRows` counts from the start.
    """
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


class LateRows(StreamingQueryListener):
    """Rows dropped by the watermark, by query id; add it with ``spark.streams.addListener``."""

    def __init__(self):
        self.dropped: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        for operator in event.progress.stateOperators:
            self.dropped[str(event.progress.id)] += operator.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
