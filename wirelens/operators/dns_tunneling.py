"""DNS tunnelling: query volume in a sliding minute, and oversized queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.functions.text import fixed, json_of, rounded
from wirelens.operators.alerts import Detector, Group, alert_rows, member_rows
from wirelens.operators.time_windows import first_burst
from wirelens.plans.traffic import LARGE_PAYLOAD, MINUTE_US, Traffic, roll_up

CATEGORY = "DNS_TUNNELING"
SOURCE = ["capture_id", "src_ip"]


def volume_details(
    traffic: Traffic, queries_above: int = 100, window_us: int = MINUTE_US, **_
) -> DataFrame:
    """One row per bursting source and destination."""
    events = traffic.packets.filter(net.is_dns()).select(*SOURCE, "ts_us")
    bursts = first_burst(events, SOURCE, queries_above + 1, window_us)
    dns = traffic.contacts.filter(F.col("n_dns") > 0)
    return roll_up(dns, *SOURCE, "dst_ip").select(*SOURCE, "dst_ip").join(bursts, SOURCE)


def volume_alerts(
    details: DataFrame, queries_above: int = 100, window_us: int = MINUTE_US, **_
) -> DataFrame:
    sources = details.groupBy(*SOURCE, "burst_n", "first_us", "last_us").agg(
        *Group.aggregates("dst_ip", "dst")
    )
    window_seconds = window_us // 1_000_000
    return alert_rows(
        sources,
        "dns_tunneling_volume",
        "high",
        CATEGORY,
        ["src_ip"],
        F.format_string(
            f"DNS tunneling suspected from %s: %d queries in {window_seconds}s",
            "src_ip",
            "burst_n",
        ),
        Group.of_one("src_ip"),
        Group.read("dst"),
        "first_us",
        "last_us",
        json_of(
            pattern=F.lit("high_query_volume"),
            queries_in_window=F.col("burst_n"),
            window_seconds=F.lit(window_seconds),
            threshold=F.lit(queries_above),
        ),
    )


def oversized_details(traffic: Traffic, payload_above: int = LARGE_PAYLOAD, **_) -> DataFrame:
    if payload_above != LARGE_PAYLOAD:  # the shared measures do not cover another size
        large = traffic.packets.filter(net.is_dns() & (F.col("payload_size") > payload_above))
        return large.groupBy(*SOURCE, "dst_ip").agg(
            F.count("*").alias("n_large_dns"),
            F.sum("payload_size").alias("large_dns_bytes"),
            F.min("ts_us").alias("large_dns_first_us"),
            F.max("ts_us").alias("large_dns_last_us"),
        )
    contacts = traffic.contacts.filter(F.col("n_large_dns") > 0)
    return roll_up(contacts, *SOURCE, "dst_ip").select(
        *SOURCE,
        "dst_ip",
        "n_large_dns",
        "large_dns_bytes",
        "large_dns_first_us",
        "large_dns_last_us",
    )


def oversized_alerts(
    details: DataFrame, queries_at_least: int = 20, payload_above: int = LARGE_PAYLOAD, **_
) -> DataFrame:
    sources = (
        details.groupBy(*SOURCE)
        .agg(
            F.sum("n_large_dns").alias("n"),
            F.sum("large_dns_bytes").alias("bytes"),
            F.min("large_dns_first_us").alias("first_us"),
            F.max("large_dns_last_us").alias("last_us"),
            *Group.aggregates("dst_ip", "dst"),
        )
        .filter(F.col("n") >= queries_at_least)
        .withColumn("average", F.col("bytes") / F.col("n"))
    )
    return alert_rows(
        sources,
        "dns_tunneling_oversized_queries",
        "high",
        CATEGORY,
        ["src_ip"],
        F.format_string(
            "DNS tunneling suspected from %s: %d oversized queries (avg %s bytes payload)",
            "src_ip",
            "n",
            fixed("average", 0),
        ),
        Group.of_one("src_ip"),
        Group.read("dst"),
        "first_us",
        "last_us",
        json_of(
            pattern=F.lit("oversized_queries"),
            large_query_count=F.col("n"),
            average_payload_bytes=rounded("average", 1),
            payload_threshold_bytes=F.lit(payload_above),
        ),
    )


def _dns_members(rule: str):
    def members(details: DataFrame, alerts: DataFrame) -> DataFrame:
        wanted = alerts.filter((F.col("rule_name") == rule) & (F.col("n_dest_ips") > 1)).select(
            "capture_id", "alert_id", F.col("source_ip").alias("src_ip")
        )
        return member_rows(details.join(wanted, SOURCE), "dest_ip", "dst_ip")

    return members


VOLUME = Detector(
    "dns_tunneling_volume",
    volume_details,
    volume_alerts,
    _dns_members("dns_tunneling_volume"),
    costly=True,
)
OVERSIZED = Detector(
    "dns_tunneling_oversized_queries",
    oversized_details,
    oversized_alerts,
    _dns_members("dns_tunneling_oversized_queries"),
)
