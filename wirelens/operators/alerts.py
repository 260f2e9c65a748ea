"""Shape of an alert row, and its members in long form."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.schemas import ALERTS, MEMBERS

# The order in which rules are evaluated.
RULE_ORDER = [
    "vertical_port_scan",
    "horizontal_port_scan",
    "syn_scan",
    "xmas_scan",
    "syn_flood",
    "udp_flood",
    "icmp_flood",
    "http_flood",
    "ssh_brute_force",
    "http_brute_force",
    "malicious_port",
    "beaconing",
    "data_exfiltration",
    "dns_tunneling_volume",
    "dns_tunneling_oversized_queries",
]


@dataclass(frozen=True)
class Group:
    """Summary of a set of addresses: a first one, how many, and a signature of the set."""

    first: Column
    n: Column
    signature: Column

    @staticmethod
    def of_one(ip: str) -> Group:
        return Group(F.col(ip), F.lit(1), net.single_signature(ip))

    @staticmethod
    def none() -> Group:
        return Group(F.lit(None).cast("string"), F.lit(0), F.lit("0"))

    @staticmethod
    def aggregates(ip: str, prefix: str) -> list[Column]:
        """Aggregates over rows with one row per distinct address; read back with `read`."""
        first, second = net.set_signature(ip)
        return [
            F.min(ip).alias(f"{prefix}_first"),
            F.count(ip).alias(f"{prefix}_n"),
            first.alias(f"{prefix}_x"),
            second.alias(f"{prefix}_y"),
        ]

    @staticmethod
    def read(prefix: str) -> Group:
        return Group(
            F.col(f"{prefix}_first"),
            F.col(f"{prefix}_n"),
            net.signature_text(
                F.col(f"{prefix}_n"), F.col(f"{prefix}_x"), F.col(f"{prefix}_y")
            ),
        )


def alert_rows(
    df: DataFrame,
    rule: str,
    severity: str,
    category: str,
    key: list[Column | str],
    description: Column,
    source: Group,
    dest: Group,
    first_us: Column | str,
    last_us: Column | str,
    evidence: Column,
) -> DataFrame:
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    rule_ord = RULE_ORDER.index(rule) if rule in RULE_ORDER else len(RULE_ORDER)
    values = {
        "capture_id": F.col("capture_id"),
        "alert_id": F.concat_ws("|", F.lit(rule), *[p.cast("string") for p in parts]),
        "rule_name": F.lit(rule),
        "rule_ord": F.lit(rule_ord),
        "severity": F.lit(severity),
        "category": F.lit(category),
        "description": description,
        "source_ip": source.first,
        "n_source_ips": source.n,
        "source_set": source.signature,
        "dest_ip": dest.first,
        "n_dest_ips": dest.n,
        "first_us": F.col(first_us) if isinstance(first_us, str) else first_us,
        "last_us": F.col(last_us) if isinstance(last_us, str) else last_us,
        "evidence": evidence,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in ALERTS.fields])


def single_members(alerts: DataFrame) -> DataFrame:
    """Members that the alert row already names in full."""
    entries = F.array(
        *[
            F.when(
                F.col(f"n_{role}s") == 1,
                F.struct(F.lit(role).alias("role"), F.col(role).alias("value")),
            )
            for role in ("source_ip", "dest_ip")
        ]
    )
    return (
        alerts.select("capture_id", "alert_id", F.explode(entries).alias("m"))
        .filter(F.col("m").isNotNull())
        .select("capture_id", "alert_id", "m.role", "m.value")
    )


def member_rows(df: DataFrame, role: str, value: str) -> DataFrame:
    return df.select(
        "capture_id", "alert_id", F.lit(role).alias("role"), F.col(value).alias("value")
    ).to(MEMBERS)


@dataclass(frozen=True)
class Detector:
    """One or more rules that share their detail rows.

    details: Traffic -> rows that alerts and members are both made from
    alerts:  details -> alert rows
    members: (details, alerts) -> member rows of the lists with more than one entry
    """

    name: str
    details: Callable[..., DataFrame]
    alerts: Callable[..., DataFrame]
    members: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    needs_logs: bool = False
    costly: bool = False  # details are worth writing down when members are wanted too

    def run(self, traffic, **params) -> DataFrame:
        return self.alerts(self.details(traffic, **params), **params)
