"""The whole analysis, from packets and log entries to threats and summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from wirelens.operators import features, reports, summaries
from wirelens.operators.classify import Threats, classify, ordered
from wirelens.plans.rules import rule_results
from wirelens.plans.traffic import Traffic
from wirelens.session import scratch_table


class Analysis(NamedTuple):
    features: DataFrame
    alerts: DataFrame
    anomalies: DataFrame | None
    threats: Threats
    summary: DataFrame
    facts: DataFrame


def analyse(
    traffic: Traffic,
    *,
    window_seconds: int = 60,
    sensitivity: float = 0.05,
    with_anomalies: bool = True,
    merge: str = "in_order",
) -> Analysis:
    """Features, rules, anomaly vote, classification and summaries of every capture."""
    from wirelens.operators.anomaly.ensemble import detect_anomalies

    traffic = traffic.prepared()
    windows = scratch_table(features.window_features(traffic, window_seconds), "features")
    results = rule_results(traffic, durable=True)
    anomalies = None
    if with_anomalies:
        anomalies = detect_anomalies(windows, window_seconds, sensitivity)
    threats = classify(results.alerts, results.members, anomalies, merge)
    summary = summaries.capture_summary(traffic)
    return Analysis(
        windows,
        results.alerts,
        anomalies,
        threats._replace(threats=ordered(threats.threats)),
        summary,
        reports.executive_facts(threats.threats, summary),
    )


__all__ = ["Analysis", "analyse"]
