"""Packet tables, text logs, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.functions.text import iso_to_us
from wirelens.operators.logs import parse_lines
from wirelens.schemas import PACKETS, with_packet_defaults
from wirelens.session import small_side, spread

# Packets as exported by other tools: ISO times as text, no capture or arrival columns.
RECORD_SCHEMA = (
    "timestamp string, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol string, size int, tcp_flags array<string>, payload_size int"
)
CSV_SCHEMA = RECORD_SCHEMA.replace("tcp_flags array<string>", "tcp_flags string")


def read_packet_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Packets in the library's own schema; filters and columns reach a Parquet scan."""
    return with_packet_defaults(spark.read.schema(PACKETS).format(fmt).load(path))


def read_packet_records(
    spark: SparkSession, path: str, fmt: str = "json", header: bool = True
) -> DataFrame:
    """Records with ISO times (JSON, Parquet, or CSV with `|`-separated flags).

    capture_id is the file; the arrival order is that of the lines.
    """
    if fmt == "csv":
        raw = spark.read.schema(CSV_SCHEMA).csv(path, header=header).withColumn(
            "tcp_flags",
            F.when(F.coalesce("tcp_flags", F.lit("")) == "", F.array().cast("array<string>")).otherwise(
                F.split("tcp_flags", r"\|")
            ),
        )
    else:
        raw = spark.read.schema(RECORD_SCHEMA).format(fmt).load(path)
    rows = raw.withColumns(
        {
            "capture_id": F.col("_metadata.file_path"),
            "ts_us": iso_to_us("timestamp"),
            "block": F.col("_metadata.file_block_start"),
            "place": F.monotonically_increasing_id(),
        }
    )
    # A split has fewer records than bytes, so its start plus the place in it orders a whole file.
    in_split = F.col("place") - F.col("first_place")
    firsts = small_side(
        rows.groupBy("capture_id", "block").agg(F.min("place").alias("first_place")), 100_000
    )
    return (
        with_packet_defaults(rows.join(firsts, ["capture_id", "block"]))
        .withColumn("seq", F.col("block") + in_split)
        .select(PACKETS.fieldNames())
    )


def read_log_lines(spark: SparkSession, path: str, capture_id: str | None = None) -> DataFrame:
    """Raw lines of text logs: (capture_id, source_file, seq, line, modified); files are split by line."""
    file = F.col("_metadata.file_path")
    return spark.read.text(path).select(
        (file if capture_id is None else F.lit(capture_id)).alias("capture_id"),
        file.alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def read_logs(
    spark: SparkSession,
    path: str,
    *,
    capture_id: str | None = None,
    year: int | None = None,
    tz: str = "UTC",
    per_line: bool = False,
) -> DataFrame:
    """Log entries of text files. A path without any readable format is an error.

    Without `year`, syslog times are in the year that the file's last change allows.
    """
    lines = spread(read_log_lines(spark, path, capture_id))
    return parse_lines(lines, year=year, tz=tz, per_line=per_line, required=True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Alerts, threats, features or summaries, partitioned by day where they have a time."""
    time = next((c for c in ("first_us", "start_us", "window_start_us", "ts_us") if c in df.columns), None)
    writer = df
    if time is not None:
        writer = df.withColumn("capture_date", F.to_date(F.timestamp_micros(F.col(time))))
        writer.write.mode(mode).partitionBy("capture_date").format(fmt).save(path)
    else:
        writer.write.mode(mode).format(fmt).save(path)


def save_packets(packets: DataFrame, path: str) -> None:
    """Keep captured packets, for later analysis with `read_packet_table`."""
    packets.select(PACKETS.fieldNames()).write.mode("append").partitionBy("capture_id").parquet(path)
