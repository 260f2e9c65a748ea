"""Port scans: vertical, horizontal, SYN and XMAS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.text import fixed, json_of, rounded, seconds
from wirelens.operators.alerts import Detector, Group, alert_rows, member_rows
from wirelens.operators.time_windows import FOLD_ROWS, greedy_windows, slot
from wirelens.plans.traffic import MINUTE_US, Traffic, as_contacts, roll_up

CATEGORY = "PORT_SCAN"


def _scan_items(
    traffic: Traffic, keys: list[str], item: str, more_than: int, window_us: int, fold_rows: int
) -> DataFrame:
    contacts = traffic.contacts if window_us == MINUTE_US else as_contacts(traffic.packets)
    items = contacts.groupBy(
        *keys, slot(window_us, "first_us").alias("slot"), F.col(item).alias("item")
    ).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")
    )
    events = traffic.packets.select(*keys, "ts_us")
    return greedy_windows(events, items, keys, more_than, window_us, fold_rows)


# --- vertical: many ports of one target ---


def vertical_details(
    traffic: Traffic, more_than: int = 20, window_us: int = MINUTE_US, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    keys = ["capture_id", "src_ip", "dst_ip"]
    return _scan_items(traffic, keys, "dst_port", more_than, window_us, fold_rows)


def vertical_alerts(details: DataFrame, more_than: int = 20, **_) -> DataFrame:
    windows = (
        details.groupBy("capture_id", "src_ip", "dst_ip", "open_us", "close_us")
        .agg(F.count("*").alias("ports"))
        .filter(F.col("ports") > more_than)
        .withColumn("duration", seconds(F.col("close_us") - F.col("open_us")))
    )
    return alert_rows(
        windows,
        "vertical_port_scan",
        "high",
        CATEGORY,
        ["src_ip", "dst_ip", "open_us"],
        F.format_string(
            "Vertical port scan from %s to %s: %d ports in %ss",
            "src_ip",
            "dst_ip",
            "ports",
            fixed("duration", 0),
        ),
        Group.of_one("src_ip"),
        Group.of_one("dst_ip"),
        "open_us",
        "close_us",
        json_of(
            scan_type=F.lit("vertical"),
            ports_scanned=F.col("ports"),
            target=F.col("dst_ip"),
            duration_seconds=F.col("duration"),
        ),
    )


# --- horizontal: one port of many targets ---


def horizontal_details(
    traffic: Traffic, more_than: int = 10, window_us: int = MINUTE_US, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    keys = ["capture_id", "src_ip", "dst_port"]
    return _scan_items(traffic, keys, "dst_ip", more_than, window_us, fold_rows)


def horizontal_alerts(details: DataFrame, more_than: int = 10, **_) -> DataFrame:
    windows = (
        details.groupBy("capture_id", "src_ip", "dst_port", "open_us", "close_us")
        .agg(*Group.aggregates("item", "dst"))
        .filter(F.col("dst_n") > more_than)
    )
    return alert_rows(
        windows,
        "horizontal_port_scan",
        "high",
        CATEGORY,
        ["src_ip", "dst_port", "open_us"],
        F.format_string(
            "Horizontal scan from %s on port %d: %d targets", "src_ip", "dst_port", "dst_n"
        ),
        Group.of_one("src_ip"),
        Group.read("dst"),
        "open_us",
        "close_us",
        json_of(
            scan_type=F.lit("horizontal"),
            targets_scanned=F.col("dst_n"),
            port=F.col("dst_port"),
        ),
    )


def horizontal_members(details: DataFrame, alerts: DataFrame) -> DataFrame:
    named = details.withColumn(
        "alert_id",
        F.concat_ws(
            "|", F.lit("horizontal_port_scan"), "src_ip", F.col("dst_port").cast("string"),
            F.col("open_us").cast("string"),
        ),
    )
    wanted = alerts.filter(F.col("n_dest_ips") > 1).select("capture_id", "alert_id")
    return member_rows(
        named.join(wanted, ["capture_id", "alert_id"], "left_semi"), "dest_ip", "item"
    )


# --- SYN and XMAS: both per source over the whole capture, from (source, destination) rows ---


def flag_details(traffic: Traffic, **_) -> DataFrame:
    contacts = traffic.contacts.filter((F.col("n_tcp") > 0) | (F.col("n_xmas") > 0))
    return roll_up(contacts, "capture_id", "src_ip", "dst_ip")


def _per_source(details: DataFrame, kind: str, counts: list[str]) -> DataFrame:
    return details.groupBy("capture_id", "src_ip").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.min_by(f"{kind}_us0", f"{kind}_seq0").alias("first_us"),
        F.max_by(f"{kind}_us1", f"{kind}_seq1").alias("last_us"),
        *Group.aggregates("dst_ip", "dst"),
    )


def syn_alerts(
    details: DataFrame, more_than: int = 20, ratio_above: float = 0.8, **_
) -> DataFrame:
    sources = (
        _per_source(details.filter(F.col("n_tcp") > 0), "tcp", ["n_tcp", "n_syn_only"])
        .filter(F.col("n_tcp") > more_than)
        .withColumn("ratio", F.col("n_syn_only") / F.col("n_tcp"))
        .filter(F.col("ratio") > ratio_above)
    )
    return alert_rows(
        sources,
        "syn_scan",
        "medium",
        CATEGORY,
        ["src_ip"],
        F.format_string(
            "SYN scan from %s: %s%% SYN-only packets (%d total)",
            "src_ip",
            fixed(F.col("ratio") * 100, 0),
            "n_tcp",
        ),
        Group.of_one("src_ip"),
        Group.read("dst"),
        "first_us",
        "last_us",
        json_of(
            scan_type=F.lit("syn"), syn_ratio=rounded("ratio", 3), packet_count=F.col("n_tcp")
        ),
    )


def xmas_alerts(details: DataFrame, **_) -> DataFrame:
    sources = _per_source(details.filter(F.col("n_xmas") > 0), "xmas", ["n_xmas"])
    return alert_rows(
        sources,
        "xmas_scan",
        "high",
        CATEGORY,
        ["src_ip"],
        F.format_string("XMAS scan from %s: %d packets with FIN+PSH+URG", "src_ip", "n_xmas"),
        Group.of_one("src_ip"),
        Group.read("dst"),
        "first_us",
        "last_us",
        json_of(scan_type=F.lit("xmas"), packet_count=F.col("n_xmas")),
    )


def _source_members(rule: str, counted: str):
    def members(details: DataFrame, alerts: DataFrame) -> DataFrame:
        wanted = alerts.filter((F.col("rule_name") == rule) & (F.col("n_dest_ips") > 1)).select(
            "capture_id", "alert_id", F.col("source_ip").alias("src_ip")
        )
        rows = details.filter(F.col(counted) > 0).join(wanted, ["capture_id", "src_ip"])
        return member_rows(rows, "dest_ip", "dst_ip")

    return members


def flag_members(details: DataFrame, alerts: DataFrame) -> DataFrame:
    return _source_members("syn_scan", "n_tcp")(details, alerts).unionByName(
        _source_members("xmas_scan", "n_xmas")(details, alerts)
    )


def flag_alerts(details: DataFrame, **params) -> DataFrame:
    return syn_alerts(details, **params).unionByName(xmas_alerts(details))


VERTICAL = Detector("vertical_port_scan", vertical_details, vertical_alerts)
HORIZONTAL = Detector(
    "horizontal_port_scan", horizontal_details, horizontal_alerts, horizontal_members, costly=True
)
SYN = Detector("syn_scan", flag_details, syn_alerts, _source_members("syn_scan", "n_tcp"))
XMAS = Detector("xmas_scan", flag_details, xmas_alerts, _source_members("xmas_scan", "n_xmas"))
FLAGS = Detector("flag_scans", flag_details, flag_alerts, flag_members)
