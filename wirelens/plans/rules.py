"""All rules together, and rules supplied by the user."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.operators import brute_force, dns_tunneling, floods, scans, suspicious
from wirelens.operators.alerts import Detector, single_members
from wirelens.plans.traffic import Traffic
from wirelens.schemas import ALERT_SEVERITIES, ALERTS
from wirelens.session import scratch_table

# Detectors as run together: the SYN and XMAS scans share details, and so do the four floods.
DETECTORS: list[Detector] = [
    scans.VERTICAL,
    scans.HORIZONTAL,
    scans.FLAGS,
    floods.FLOODS,
    brute_force.SSH,
    brute_force.HTTP,
    suspicious.PORTS,
    suspicious.BEACONS,
    suspicious.EXFILTRATION,
    dns_tunneling.VOLUME,
    dns_tunneling.OVERSIZED,
]

# One detector per rule name, for running a single rule.
RULES: dict[str, Detector] = {
    d.name: d
    for d in [
        scans.VERTICAL,
        scans.HORIZONTAL,
        scans.SYN,
        scans.XMAS,
        floods.one_kind("syn"),
        floods.one_kind("udp"),
        floods.one_kind("icmp"),
        floods.one_kind("http"),
        brute_force.SSH,
        brute_force.HTTP,
        suspicious.PORTS,
        suspicious.BEACONS,
        suspicious.EXFILTRATION,
        dns_tunneling.VOLUME,
        dns_tunneling.OVERSIZED,
    ]
}

UserRule = Callable[[Traffic], DataFrame]
_user_rules: dict[str, UserRule] = {}


def register_rule(name: str, rule: UserRule | str) -> None:
    """Add a rule: a function `Traffic -> alerts`, or a SQL SELECT over views `packets` and `logs`.

    Either must return the alert columns; missing optional ones are filled with NULL.
    """
    if isinstance(rule, str):
        text = rule

        def rule(traffic: Traffic) -> DataFrame:
            tables = {"packets": traffic.packets}
            if traffic.logs is not None:
                tables["logs"] = traffic.logs
            for view, df in tables.items():
                df.createOrReplaceTempView(f"wirelens_{view}")
            return traffic.spark.sql(
                text.replace("{packets}", "wirelens_packets").replace("{logs}", "wirelens_logs")
            )

    _user_rules[name] = rule


def unregister_rule(name: str) -> None:
    _user_rules.pop(name, None)


def _as_alerts(df: DataFrame, name: str) -> DataFrame:
    defaults = {
        "rule_name": F.lit(name),
        "rule_ord": F.lit(1000),
        "n_source_ips": F.lit(1),
        "source_set": net.single_signature("source_ip"),
        "n_dest_ips": F.when(F.col("dest_ip").isNotNull(), 1).otherwise(0)
        if "dest_ip" in df.columns
        else F.lit(0),
    }
    columns = []
    for f in ALERTS.fields:
        value = F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def user_alerts(name: str, traffic: Traffic) -> DataFrame:
    """Alerts of one rule added with `register_rule`."""
    return _as_alerts(_user_rules[name](traffic), name)


class RuleResults(NamedTuple):
    alerts: DataFrame
    members: DataFrame


def severity_rank(column: str = "severity") -> Column:
    rank = F.array_position(F.array(*[F.lit(s) for s in ALERT_SEVERITIES]), F.col(column))
    return F.when(rank == 0, 99).otherwise(rank - 1).cast("int")


def run_rule(name: str, traffic: Traffic, **params) -> DataFrame:
    """Alerts of one rule."""
    return RULES[name].run(traffic, **params)


def _evaluate(
    traffic: Traffic, keep: bool
) -> Iterator[tuple[Detector | None, DataFrame | None, DataFrame]]:
    """(detector, details, alerts) of every rule; costly details are written down with `keep`."""
    for detector in DETECTORS:
        if detector.needs_logs and traffic.logs is None:
            continue
        details = detector.details(traffic)
        if keep and detector.costly:
            details = scratch_table(details, f"details-{detector.name}")
        yield detector, details, detector.alerts(details)
    for name in _user_rules:
        yield None, None, user_alerts(name, traffic)


def rule_results(traffic: Traffic, durable: bool = True) -> RuleResults:
    """Alerts of every rule and their members.

    With `durable`, contacts, costly details and the alerts are written once to the shared folder,
    as alerts and members are both made from them.
    """
    if durable and not traffic.is_prepared:
        traffic = traffic.prepared()
    found = list(_evaluate(traffic, keep=durable))
    every = reduce(DataFrame.unionByName, [alerts for _, _, alerts in found])
    if durable:
        every = scratch_table(every, "alerts")
    members = [single_members(every)]
    for detector, details, _ in found:
        if detector is not None and detector.members:
            members.append(detector.members(details, every))
    return RuleResults(every, reduce(DataFrame.unionByName, members))


def run_rules(traffic: Traffic) -> DataFrame:
    """Alerts of every rule, most severe first; equal severities in rule order."""
    if not traffic.is_prepared:
        traffic = traffic.prepared()
    alerts = reduce(
        DataFrame.unionByName, [alerts for _, _, alerts in _evaluate(traffic, keep=False)]
    )
    return alerts.withColumn("severity_rank", severity_rank()).orderBy(
        "capture_id", "severity_rank", "rule_ord", "alert_id"
    )


__all__ = [
    "DETECTORS",
    "RULES",
    "RuleResults",
    "register_rule",
    "rule_results",
    "run_rule",
    "run_rules",
    "severity_rank",
    "unregister_rule",
    "user_alerts",
]
