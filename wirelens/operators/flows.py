"""Connection flows: packets grouped by directional 5-tuple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.text import seconds

FLOW_KEY = ["capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def build_flows(packets: DataFrame) -> DataFrame:
    return (
        packets.groupBy(*FLOW_KEY)
        .agg(
            F.count("*").alias("packet_count"),
            F.sum("size").alias("total_bytes"),
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("end_us"),
        )
        .withColumn("duration_seconds", seconds(F.col("end_us") - F.col("start_us")))
    )
