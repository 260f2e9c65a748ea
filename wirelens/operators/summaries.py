"""Summaries of captures: protocols, ports, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.text import iso_time
from wirelens.plans.traffic import Traffic


def protocol_distribution(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id", "protocol").agg(F.count("*").alias("packets"))


def protocol_breakdown(packets: DataFrame) -> DataFrame:
    """Share of each protocol in percent, largest first."""
    total = F.sum("packets").over(Window.partitionBy("capture_id"))
    return (
        protocol_distribution(packets)
        .withColumn("share_pct", F.col("packets") / F.greatest(total, F.lit(1)) * 100)
        .orderBy("capture_id", F.desc("packets"), "protocol")
    )


def top_ports(packets: DataFrame, k: int = 15) -> DataFrame:
    """The k destination ports with the most packets, over all captures given."""
    return (
        packets.groupBy("dst_port")
        .agg(F.count("*").alias("packets"))
        .orderBy(F.desc("packets"), "dst_port")
        .limit(k)
    )


def _file_name(path: str) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def capture_summary(traffic: Traffic, approximate: bool = False) -> DataFrame:
    """One row per capture: its files, packets, addresses, protocols, time range by arrival, log entries.

    Distinct addresses are counted per (capture, address) first. `unique_ips` adds sources and
    destinations up, so an address seen in both roles counts twice.
    """
    packets = traffic.packets
    if approximate:
        ends = packets.groupBy("capture_id").agg(
            F.count("*").alias("packet_count"),
            F.approx_count_distinct("src_ip").alias("unique_src_ips"),
            F.approx_count_distinct("dst_ip").alias("unique_dst_ips"),
            F.min_by("ts_us", "seq").alias("first_us"),
            F.max_by("ts_us", "seq").alias("last_us"),
        )
        protocols = protocol_distribution(packets)
    else:
        pairs = traffic.contacts.groupBy("capture_id", "src_ip", "dst_ip", "protocol").agg(
            F.sum("n").alias("n"),
            F.min_by("any_us0", "any_seq0").alias("us0"),
            F.max_by("any_us1", "any_seq1").alias("us1"),
            F.min("any_seq0").alias("seq0"),
            F.max("any_seq1").alias("seq1"),
        )
        ends = pairs.groupBy("capture_id").agg(
            F.sum("n").alias("packet_count"),
            F.count_distinct("src_ip").alias("unique_src_ips"),
            F.count_distinct("dst_ip").alias("unique_dst_ips"),
            F.min_by("us0", "seq0").alias("first_us"),
            F.max_by("us1", "seq1").alias("last_us"),
        )
        protocols = pairs.select("capture_id", "protocol").distinct()
    names = protocols.groupBy("capture_id").agg(
        F.array_join(F.array_sort(F.collect_set("protocol")), ", ").alias("protocols")
    )
    summary = ends.join(names, "capture_id")
    if traffic.logs is not None:
        of_files = traffic.entries.groupBy("capture_id", "source_file").agg(F.count("*").alias("n"))
        entries = of_files.groupBy("capture_id").agg(
            F.sum("n").alias("log_entries"),
            F.array_sort(F.collect_set(_file_name("source_file"))).alias("log_files"),
        )
        summary = summary.join(entries, "capture_id", "left")
    else:
        summary = summary.withColumns({"log_entries": F.lit(0), "log_files": F.lit(None).cast("array<string>")})
    files = F.concat(F.array(_file_name("capture_id")), F.coalesce("log_files", F.array().cast("array<string>")))
    return summary.select(
        "capture_id",
        F.array_join(files, ", ").alias("source_files"),
        "packet_count",
        "unique_src_ips",
        "unique_dst_ips",
        (F.col("unique_src_ips") + F.col("unique_dst_ips")).alias("unique_ips"),
        "protocols",
        F.concat(iso_time("first_us"), F.lit(" – "), iso_time("last_us")).alias("time_range"),
        F.coalesce("log_entries", F.lit(0)).cast("bigint").alias("log_entries"),
    )


SKETCHED = ("src_ip", "dst_ip")


def address_sketches(packets: DataFrame) -> DataFrame:
    """(capture_id, day, packets, src_ip_sketch, dst_ip_sketch): what later runs merge without the packets."""
    return packets.groupBy("capture_id", F.to_date(F.timestamp_micros("ts_us")).alias("day")).agg(
        F.count("*").alias("packets"), *[F.hll_sketch_agg(c).alias(f"{c}_sketch") for c in SKETCHED]
    )


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of any days and captures as one per key: (keys, packets, src_ip_sketch, dst_ip_sketch)."""
    return sketches.groupBy(*keys).agg(
        F.sum("packets").alias("packets"),
        *[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in SKETCHED],
    )


def sketched_distincts(sketches: DataFrame) -> DataFrame:
    """Sketches as numbers of distinct addresses, within about two percent."""
    kept = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(
        *kept, *[F.hll_sketch_estimate(f"{c}_sketch").alias(f"unique_{c}s") for c in SKETCHED]
    )
