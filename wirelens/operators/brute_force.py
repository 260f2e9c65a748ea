"""Brute force: repeated log entries of one source inside a sliding minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.logs import request_path
from wirelens.functions.text import fixed, json_of, seconds
from wirelens.operators.alerts import Detector, Group, alert_rows, member_rows
from wirelens.operators.time_windows import first_burst
from wirelens.plans.traffic import MINUTE_US, Traffic

CATEGORY = "BRUTE_FORCE"
KEYS = ["capture_id", "source_ip"]


def _with_burst(entries: DataFrame, at_least: int, window_us: int) -> DataFrame:
    """Entries of sources that burst, with the burst and the source's arrival extremes."""
    bursts = first_burst(entries.select(*KEYS, "ts_us"), KEYS, at_least, window_us)
    bursts = bursts.withColumnsRenamed({"first_us": "burst_us0", "last_us": "burst_us1"})
    return entries.join(bursts, KEYS)


def _arrivals() -> list:
    return [
        F.min_by("ts_us", "seq").alias("first_us"),
        F.max_by("ts_us", "seq").alias("last_us"),
    ]


BURST = ["burst_n", "burst_us0", "burst_us1"]


def ssh_details(
    traffic: Traffic, ssh_at_least: int = 5, window_us: int = MINUTE_US, **_
) -> DataFrame:
    entries = traffic.kept_troubles.filter(is_failed_ssh_login())
    found = _with_burst(entries, ssh_at_least, window_us)
    return found.groupBy(*KEYS, *BURST).agg(*_arrivals())


def ssh_alerts(details: DataFrame, **_) -> DataFrame:
    sources = details.withColumn("duration", seconds(F.col("burst_us1") - F.col("burst_us0")))
    return alert_rows(
        sources,
        "ssh_brute_force",
        "high",
        CATEGORY,
        ["source_ip"],
        F.format_string(
            "SSH brute force from %s: %d failed attempts in %ss",
            "source_ip",
            "burst_n",
            fixed("duration", 0),
        ),
        Group.of_one("source_ip"),
        Group.none(),
        "first_us",
        "last_us",
        json_of(
            attack_type=F.lit("ssh"),
            attempts=F.col("burst_n"),
            duration_seconds=F.col("duration"),
            target_service=F.lit("sshd"),
        ),
    )


def is_failed_ssh_login():
    return F.lower("service").contains("ssh") & (F.col("severity") == "high")


def is_login_attempt():
    text = F.lower("message")
    return (
        F.col("message").contains("POST")
        & (text.contains("login") | text.contains("auth"))
        & (F.col("severity") != "info")
    )


def http_details(
    traffic: Traffic, http_at_least: int = 10, window_us: int = MINUTE_US, **_
) -> DataFrame:
    """One row per bursting source and requested path."""
    entries = traffic.kept_troubles.filter(is_login_attempt())
    found = _with_burst(entries, http_at_least, window_us)
    return found.groupBy(*KEYS, *BURST, request_path("message").alias("path")).agg(
        *_arrivals(), F.min("seq").alias("seq0"), F.max("seq").alias("seq1")
    )


def http_alerts(details: DataFrame, **_) -> DataFrame:
    sources = details.groupBy(*KEYS, *BURST).agg(
        F.min_by("first_us", "seq0").alias("first_us"),
        F.max_by("last_us", "seq1").alias("last_us"),
        F.count("*").alias("paths"),
    )
    return alert_rows(
        sources,
        "http_brute_force",
        "high",
        CATEGORY,
        ["source_ip"],
        F.format_string("HTTP login brute force from %s: %d attempts", "source_ip", "burst_n"),
        Group.of_one("source_ip"),
        Group.none(),
        "first_us",
        "last_us",
        json_of(
            attack_type=F.lit("http_login"),
            attempts=F.col("burst_n"),
            paths_targeted=F.col("paths"),
        ),
    )


def http_members(details: DataFrame, alerts: DataFrame) -> DataFrame:
    """The targeted paths, in long form."""
    named = details.withColumn("alert_id", F.concat_ws("|", F.lit("http_brute_force"), "source_ip"))
    return member_rows(named, "path", "path")


SSH = Detector("ssh_brute_force", ssh_details, ssh_alerts, needs_logs=True)
HTTP = Detector("http_brute_force", http_details, http_alerts, http_members, True, True)
