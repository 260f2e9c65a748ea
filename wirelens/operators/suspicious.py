"""Suspicious connections: known bad ports, beaconing, large outbound flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.functions.text import fixed, grouped, json_of, rounded
from wirelens.operators.alerts import Detector, Group, alert_rows, member_rows
from wirelens.operators.flows import FLOW_KEY, build_flows
from wirelens.operators.time_windows import gap_statistics
from wirelens.plans.traffic import Traffic

CATEGORY = "SUSPICIOUS_CONNECTION"


# --- known bad ports ---


def port_details(
    traffic: Traffic, ports: list[int] | None = None, indicators: DataFrame | None = None, **_
) -> DataFrame:
    """Rows per (port, source, destination). `indicators` is an optional table of ports (`port`)."""
    packets = traffic.packets
    if indicators is None:
        listed = net.MALICIOUS_PORTS if ports is None else ports
        packets = packets.filter(F.col("dst_port").isin(listed) | F.col("src_port").isin(listed))
    matches = packets.select(
        "capture_id",
        "seq",
        "ts_us",
        "src_ip",
        "dst_ip",
        F.posexplode(F.array("dst_port", "src_port")).alias("side", "port"),
    )
    if indicators is None:
        matches = matches.filter(F.col("port").isin(listed))
    else:
        matches = matches.join(indicators.select("port").distinct(), "port", "left_semi")
    return matches.groupBy("capture_id", "port", "src_ip", "dst_ip").agg(
        F.count("*").alias("n"),
        F.min_by("ts_us", "seq").alias("us0"),
        F.max_by("ts_us", "seq").alias("us1"),
        F.min("seq").alias("seq0"),
        F.max("seq").alias("seq1"),
    )


def _per_side(details: DataFrame, side: str) -> DataFrame:
    """One row per (port, address) with the measures of that side."""
    return details.groupBy("capture_id", "port", F.col(f"{side}_ip").alias("ip")).agg(
        F.sum("n").alias("n"),
        F.min_by("us0", "seq0").alias("us0"),
        F.max_by("us1", "seq1").alias("us1"),
        F.min("seq0").alias("seq0"),
        F.max("seq1").alias("seq1"),
    )


def port_alerts(details: DataFrame, **_) -> DataFrame:
    key = ["capture_id", "port"]
    sources = _per_side(details, "src").groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.min_by("us0", "seq0").alias("first_us"),
        F.max_by("us1", "seq1").alias("last_us"),
        *Group.aggregates("ip", "src"),
    )
    dests = _per_side(details, "dst").groupBy(*key).agg(*Group.aggregates("ip", "dst"))
    return alert_rows(
        sources.join(dests, key),
        "malicious_port",
        "high",
        CATEGORY,
        ["port"],
        F.format_string("Traffic on suspicious port %d: %d packets", "port", "n"),
        Group.read("src"),
        Group.read("dst"),
        "first_us",
        "last_us",
        json_of(
            detection_type=F.lit("malicious_port"), port=F.col("port"), connections=F.col("n")
        ),
    )


def port_members(details: DataFrame, alerts: DataFrame) -> DataFrame:
    rows = details.withColumn(
        "alert_id", F.concat_ws("|", F.lit("malicious_port"), F.col("port").cast("string"))
    )
    parts = []
    for role, column, counted in (
        ("source_ip", "src_ip", "n_source_ips"),
        ("dest_ip", "dst_ip", "n_dest_ips"),
    ):
        wanted = alerts.filter(F.col(counted) > 1).select("capture_id", "alert_id")
        found = rows.join(wanted, ["capture_id", "alert_id"], "left_semi")
        parts.append(member_rows(found, role, column).distinct())
    return parts[0].unionByName(parts[1])


# --- beaconing ---


def beacon_details(
    traffic: Traffic,
    beacons_above: int = 5,
    deviation_below_s: float = 5.0,
    min_mean_interval_s: float = 0.0,
    **_,
) -> DataFrame:
    events = traffic.packets.select("capture_id", "src_ip", "dst_ip", "ts_us")
    return gap_statistics(events, ["capture_id", "src_ip", "dst_ip"]).filter(
        (F.col("n") > beacons_above)
        & (F.col("std_gap_us") < deviation_below_s * 1e6)
        & (F.col("mean_gap_us") >= min_mean_interval_s * 1e6)
    )


def beacon_alerts(details: DataFrame, **_) -> DataFrame:
    pairs = details.withColumns(
        {"mean_s": F.col("mean_gap_us") / 1e6, "std_s": F.col("std_gap_us") / 1e6}
    )
    return alert_rows(
        pairs,
        "beaconing",
        "critical",
        CATEGORY,
        ["src_ip", "dst_ip"],
        F.format_string(
            "Potential C2 beaconing: %s -> %s (avg interval %ss, std %ss)",
            "src_ip",
            "dst_ip",
            fixed("mean_s", 1),
            fixed("std_s", 1),
        ),
        Group.of_one("src_ip"),
        Group.of_one("dst_ip"),
        "first_us",
        "last_us",
        json_of(
            detection_type=F.lit("beaconing"),
            avg_interval_seconds=rounded("mean_s", 2),
            std_deviation=rounded("std_s", 2),
            beacon_count=F.col("n"),
        ),
    )


# --- large outbound flows ---


def exfiltration_details(traffic: Traffic, bytes_above: int = 10_000_000, **_) -> DataFrame:
    """Large flows first: the address test then runs on few rows."""
    return build_flows(traffic.packets).filter(
        (F.col("total_bytes") > bytes_above)
        & net.is_internal_ip("src_ip")
        & ~net.is_internal_ip("dst_ip")
    )


def exfiltration_alerts(details: DataFrame, **_) -> DataFrame:
    return alert_rows(
        details,
        "data_exfiltration",
        "high",
        CATEGORY,
        FLOW_KEY[1:],
        F.format_string(
            "Large outbound transfer: %s -> %s (%s bytes)",
            "src_ip",
            "dst_ip",
            grouped("total_bytes"),
        ),
        Group.of_one("src_ip"),
        Group.of_one("dst_ip"),
        "start_us",
        "end_us",
        json_of(
            detection_type=F.lit("data_exfiltration"),
            bytes_transferred=F.col("total_bytes"),
            destination=F.col("dst_ip"),
        ),
    )


PORTS = Detector("malicious_port", port_details, port_alerts, port_members)
BEACONS = Detector("beaconing", beacon_details, beacon_alerts)
EXFILTRATION = Detector("data_exfiltration", exfiltration_details, exfiltration_alerts)
