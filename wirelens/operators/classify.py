"""Alerts to scored threats: conversion, merging of overlapping ones, ordering.

A threat row keeps its members (addresses) and evidence in long form: `threat_members` and
`threat_evidence` follow from the `assignment` of alerts to threats.
"""

from __future__ import annotations

import heapq
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.text import iso_time, json_of
from wirelens.session import scratch_table

# Base scores, titles and recommendations per category.
BASE_SCORES = {"critical": 80, "high": 60, "medium": 40, "low": 20}
DEFAULT_SCORE = 20
SCORE_LABELS = [(80, "critical"), (60, "high"), (40, "medium")]
RECOMMENDATIONS = {
    "PORT_SCAN": [
        "Block source IP at firewall",
        "Review firewall rules for exposed ports",
        "Enable IDS/IPS signatures for scan detection",
    ],
    "DDOS_ATTACK": [
        "Enable rate limiting on affected services",
        "Configure SYN cookies",
        "Contact upstream provider for traffic scrubbing",
    ],
    "BRUTE_FORCE": [
        "Implement account lockout policies",
        "Enable fail2ban or similar",
        "Enforce strong passwords and MFA",
    ],
    "SUSPICIOUS_CONNECTION": [
        "Isolate affected host for investigation",
        "Block communication to suspicious destination",
        "Conduct forensic analysis of the endpoint",
    ],
    "DNS_TUNNELING": [
        "Block outbound DNS to untrusted resolvers; force traffic through internal DNS",
        "Inspect logs of the source host for unauthorised processes",
        "Add the destination domain(s) to a DNS sinkhole or blocklist",
    ],
    "ANOMALOUS_TRAFFIC": [
        "Investigate traffic patterns in the flagged time window",
        "Correlate with system logs for additional context",
        "Review baseline thresholds and adjust if needed",
    ],
}
TITLES = {
    "PORT_SCAN": ("Vertical Port Scan from ", "source_ip"),
    "DDOS_ATTACK": ("DDoS Attack targeting ", "dest_ip"),
    "BRUTE_FORCE": ("Brute Force from ", "source_ip"),
    "SUSPICIOUS_CONNECTION": ("Suspicious Connection to ", "dest_ip"),
    "DNS_TUNNELING": ("DNS Tunneling from ", "source_ip"),
}
UNTARGETED_DDOS = "DDoS Attack detected"

# Candidate threats in the order in which merging looks at them.
RULE_SOURCE, ML_SOURCE = 0, 1
ORDER = ["source_kind", "severity_rank", "rule_ord", "alert_id"]


def recommendations(category: Column | str) -> Column:
    """Recommendations of a category as an array; empty for an unknown one."""
    table = F.create_map(
        *[
            part
            for name, texts in RECOMMENDATIONS.items()
            for part in (F.lit(name), F.array(*[F.lit(t) for t in texts]))
        ]
    )
    return F.coalesce(F.try_element_at(table, category), F.array().cast("array<string>"))


def base_score(severity: str = "severity") -> Column:
    score = F.lit(DEFAULT_SCORE)
    for name, value in BASE_SCORES.items():
        score = F.when(F.col(severity) == name, value).otherwise(score)
    return score


def title() -> Column:
    text = F.concat(F.initcap(F.lower(F.replace("category", F.lit("_"), F.lit(" ")))), F.lit(" detected"))
    text = F.when(F.col("category") == "DDOS_ATTACK", UNTARGETED_DDOS).otherwise(text)
    for category, (prefix, column) in TITLES.items():
        text = F.when(
            (F.col("category") == category) & F.col(column).isNotNull(),
            F.concat(F.lit(prefix), column),
        ).otherwise(text)
    return text


def time_range(first_us: str = "first_us", last_us: str = "last_us") -> Column:
    return F.coalesce(
        F.concat(iso_time(first_us), F.lit(" – "), iso_time(last_us)), F.lit("")
    )


THREAT_COLUMNS = [
    "capture_id",
    "alert_id",
    "category",
    "severity_score",
    "severity_label",
    "title",
    "description",
    "detection_method",
    "source_ip",
    "n_source_ips",
    "source_set",
    "dest_ip",
    "n_dest_ips",
    "first_us",
    "last_us",
    "evidence",
    *ORDER[:-1],
]


def threats_from_rules(alerts: DataFrame) -> DataFrame:
    from wirelens.plans.rules import severity_rank

    return alerts.withColumns(
        {
            "severity_score": base_score(),
            "severity_label": F.col("severity"),
            "title": title(),
            "detection_method": F.lit("rule"),
            "source_kind": F.lit(RULE_SOURCE),
            "severity_rank": severity_rank(),
        }
    ).select(*THREAT_COLUMNS)


def threats_from_anomalies(anomalies: DataFrame) -> DataFrame:
    """`anomalies`: capture_id, w, start_us, end_us, anomaly_score, contributing (array), votes."""
    score = F.expr("cast(anomaly_score * 80 as int)")
    label = F.lit("low")
    for bound, name in reversed(SCORE_LABELS):
        label = F.when(F.col("severity_score") >= bound, name).otherwise(label)
    return (
        anomalies.withColumn("severity_score", score)
        .withColumns(
            {
                "alert_id": F.concat(F.lit("anomaly|"), F.lpad(F.col("w").cast("string"), 12, "0")),
                "category": F.lit("ANOMALOUS_TRAFFIC"),
                "severity_label": label,
                "title": F.concat(
                    F.lit("Anomalous Traffic Detected ("), iso_time("start_us"), F.lit(")")
                ),
                "description": F.concat(
                    F.lit(
                        "ML ensemble flagged unusual network behavior. Contributing factors: "
                    ),
                    F.array_join(F.slice("contributing", 1, 3), ", "),
                ),
                "detection_method": F.lit("ml"),
                "source_ip": F.lit(None).cast("string"),
                "n_source_ips": F.lit(0).cast("bigint"),
                "source_set": F.lit("0"),
                "dest_ip": F.lit(None).cast("string"),
                "n_dest_ips": F.lit(0).cast("bigint"),
                "first_us": F.col("start_us"),
                "last_us": F.col("end_us"),
                "evidence": json_of(
                    anomaly_score=F.col("anomaly_score"),
                    model_votes=F.col("votes"),
                    contributing_features=F.col("contributing"),
                ),
                "source_kind": F.lit(ML_SOURCE),
                "severity_rank": F.lit(0),
                "rule_ord": F.lit(0),
            }
        )
        .select(*THREAT_COLUMNS)
    )


GROUP = ["capture_id", "category", "source_set"]
METHOD_CODE = {"rule": 0, "ml": 1, "both": 2}
ASSIGNMENT = (
    "capture_id string, alert_id string, island string, threat_no bigint, epoch bigint, "
    "leads boolean, joins_methods boolean"
)


def _with_order(candidates: DataFrame) -> DataFrame:
    """`ord_key` sorts as merging looks at the candidates: rules by severity, then anomalies."""
    key = F.concat_ws(
        ".",
        F.col("source_kind").cast("string"),
        F.lpad(F.col("severity_rank").cast("string"), 3, "0"),
        F.lpad(F.col("rule_ord").cast("string"), 5, "0"),
        F.col("alert_id"),
    )
    return candidates.withColumn("ord_key", key)


def overlap_islands(candidates: DataFrame) -> DataFrame:
    """Name the groups of candidates linked by overlap; different islands never merge.

    The running maximum streams over the sorted rows of a group; nothing is collected.
    """
    by_start = Window.partitionBy(*GROUP).orderBy("first_us", "ord_key")
    reach = F.max("last_us").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("first_us") > reach)
    opened = candidates.withColumn("opening", F.when(opens, F.col("first_us")))
    start = F.max("opening").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn(
        "island", F.concat_ws("|", "category", "source_set", start.cast("string"))
    ).drop("opening")


class _Ranges:
    """Current ranges of numbered threats over known points in time; which smallest number meets a range.

    A range meets [first, last] if it holds `first`, or starts behind it up to `last`. A segment tree over the
    points keeps each range in the nodes that it covers whole, and the smallest number that starts in each node. A
    threat whose range changes gets a new epoch; entries of older ones go when they come up.
    """

    NONE = 1 << 62

    def __init__(self, points: np.ndarray) -> None:
        self.points = np.unique(points)
        self.size = 1 << max(0, int(len(self.points) - 1).bit_length())
        self.covering: dict[int, list[tuple[int, int]]] = {}
        self.starting: dict[int, list[tuple[int, int]]] = {}
        self.least = [self.NONE] * (2 * self.size)
        self.epoch: list[int] = []
        self.at: list[int] = []  # where each threat's current range starts

    def ranks(self, times: np.ndarray) -> list[int]:
        return np.searchsorted(self.points, times).tolist()

    def _top(self, heap: list[tuple[int, int]] | None) -> int:
        while heap and self.epoch[heap[0][0]] != heap[0][1]:
            heapq.heappop(heap)
        return heap[0][0] if heap else self.NONE

    def _starts(self, rank: int) -> None:
        node = rank + self.size
        self.least[node] = self._top(self.starting.get(rank))
        while node > 1:
            node >>= 1
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])

    def put(self, no: int, first: int, last: int) -> None:
        """Threat `no`, known or the next new one, now has the range between these ranks."""
        if no == len(self.epoch):
            self.epoch.append(0)
            self.at.append(first)
        else:
            self.epoch[no] += 1
            old, self.at[no] = self.at[no], first
            if old >= 0:
                self._starts(old)
        if last < first:  # no time is known: it meets nothing
            self.at[no] = -1
            return
        entry = (no, self.epoch[no])
        heapq.heappush(self.starting.setdefault(first, []), entry)
        self._starts(first)
        low, high = first + self.size, last + self.size + 1
        while low < high:
            if low & 1:
                heapq.heappush(self.covering.setdefault(low, []), entry)
                low += 1
            if high & 1:
                high -= 1
                heapq.heappush(self.covering.setdefault(high, []), entry)
            low, high = low >> 1, high >> 1

    def first_met(self, first: int, last: int) -> int | None:
        """The smallest number whose range meets the one between these ranks."""
        if last < first:
            return None
        best, node = self.NONE, first + self.size
        while node:
            best = min(best, self._top(self.covering.get(node)))
            node >>= 1
        low, high = first + 1 + self.size, last + self.size + 1
        while low < high:
            if low & 1:
                best = min(best, self.least[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.least[high])
            low, high = low >> 1, high >> 1
        return None if best == self.NONE else best


def _assign_island(island: pd.DataFrame) -> pd.DataFrame:
    """Give each candidate to the first threat whose current range it overlaps, else open one.

    Rows stand in order. A higher score takes over a threat: `epoch` counts these takeovers, and what an earlier
    epoch had absorbed no longer counts.
    """
    first, last = island["first_us"].to_numpy(np.int64), island["last_us"].to_numpy(np.int64)
    ranges = _Ranges(np.concatenate([first, last]))
    starts, ends = ranges.ranks(first), ranges.ranks(last)
    scores, methods = [], []
    numbers, epochs, leads, joins = [], [], [], []
    rows = zip(starts, ends, island["severity_score"].tolist(), island["method"].tolist())
    for start, end, score, method in rows:
        no = ranges.first_met(start, end)
        leading = joining = False
        if no is None:
            no, leading = len(scores), True
            scores.append(score)
            methods.append(method)
            ranges.put(no, start, end)
        elif score > scores[no]:
            scores[no], methods[no], leading = score, method, True
            ranges.put(no, start, end)
        elif {methods[no], method} == {0, 1}:
            methods[no] = METHOD_CODE["both"]
            scores[no] = min(scores[no] + BOTH_BONUS, 100)
            joining = True
        numbers.append(no)
        epochs.append(ranges.epoch[no])
        leads.append(leading)
        joins.append(joining)
    return island[["capture_id", "alert_id", "island"]].assign(
        threat_no=numbers, epoch=epochs, leads=leads, joins_methods=joins
    )


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Islands one after the other; rows arrive sorted by island and order."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        changes = (batch[["capture_id", "island"]] != batch[["capture_id", "island"]].shift()).any(axis=1)
        places = changes.cumsum()
        # Islands of one alert inside a batch need no walk; those at its ends may go on in another.
        alone = ~places.duplicated(keep=False) & ~places.isin([places.iloc[0], places.iloc[-1]])
        yield batch.loc[alone, ["capture_id", "alert_id", "island"]].assign(
            threat_no=0, epoch=0, leads=True, joins_methods=False
        )
        for _, part in batch[~alone].groupby(places[~alone], sort=False):
            key = tuple(part[["capture_id", "island"]].iloc[0])
            if held and key != tuple(held[0][["capture_id", "island"]].iloc[0]):
                yield _assign_island(pd.concat(held, ignore_index=True))
                held = []
            held.append(part)
    if held:
        yield _assign_island(pd.concat(held, ignore_index=True))


BOTH_BONUS = 15


def assign_in_order(candidates: DataFrame) -> DataFrame:
    """Order-dependent merging, as the rule text demands. Only narrow alert columns move.

    An island is one task's work, in n log n steps; islands that no range crosses are apart.
    """
    method = F.create_map(*[F.lit(x) for pair in METHOD_CODE.items() for x in pair])
    islands = overlap_islands(candidates).select(
        "capture_id",
        "alert_id",
        "island",
        "ord_key",
        F.coalesce("first_us", F.lit(0)).alias("first_us"),
        F.coalesce("last_us", F.lit(-1)).alias("last_us"),
        F.col("severity_score").cast("bigint").alias("severity_score"),
        F.try_element_at(method, F.col("detection_method")).cast("bigint").alias("method"),
    )
    return (
        islands.repartition("capture_id", "island")
        .sortWithinPartitions("capture_id", "island", "ord_key")
        .mapInPandas(_assign, ASSIGNMENT)
    )


def assign_whole_islands(candidates: DataFrame) -> DataFrame:
    """Alternative: everything linked by overlap is one threat, led by its highest score."""
    islands = overlap_islands(candidates)
    best = Window.partitionBy("capture_id", "island").orderBy(
        F.desc("severity_score"), "ord_key"
    )
    both = Window.partitionBy("capture_id", "island")
    methods = F.max("detection_method").over(both) != F.min("detection_method").over(both)
    first = F.row_number().over(best) == 1
    return islands.select(
        "capture_id",
        "alert_id",
        "island",
        F.lit(0).cast("bigint").alias("threat_no"),
        F.lit(0).cast("bigint").alias("epoch"),
        first.alias("leads"),
        (methods & first).alias("joins_methods"),
    )


class Threats(NamedTuple):
    """threats: one row each, members: their addresses, evidence: key and value in long form."""

    threats: DataFrame
    members: DataFrame
    evidence: DataFrame


def classify(
    alerts: DataFrame,
    members: DataFrame,
    anomalies: DataFrame | None = None,
    merge: str = "in_order",
    durable: bool = True,
) -> Threats:
    """Scored threats from alerts and anomalies. `merge` is `in_order` or `whole_islands`."""
    candidates = threats_from_rules(alerts)
    if anomalies is not None:
        candidates = candidates.unionByName(threats_from_anomalies(anomalies))
    candidates = _with_order(candidates)
    assign = {"in_order": assign_in_order, "whole_islands": assign_whole_islands}[merge]
    if durable:
        candidates = scratch_table(candidates, "candidates")
    assigned = assign(candidates)
    if durable:
        assigned = scratch_table(assigned, "assigned")
    by_threat = ["capture_id", "island", "threat_no"]
    final = assigned.groupBy(*by_threat).agg(F.max("epoch").alias("epoch"))
    kept = assigned.join(final, [*by_threat, "epoch"])  # rows of the last epoch only
    per_threat = kept.groupBy(*by_threat).agg(
        F.max(F.when(F.col("leads"), F.col("alert_id"))).alias("threat_id"),
        F.max("joins_methods").alias("both"),
    )
    opened = (
        assigned.join(candidates.select("capture_id", "alert_id", "ord_key", *GROUP[1:]), ["capture_id", "alert_id"])
    )
    sizes = opened.groupBy(*by_threat, *GROUP[1:]).agg(
        F.count("*").alias("n_alerts"), F.min("ord_key").alias("open_key")
    )
    group_keys = sizes.groupBy(*GROUP).agg(F.min("open_key").alias("group_key"))
    heads = (
        per_threat.join(sizes, by_threat)
        .join(group_keys, GROUP)
        .select("capture_id", "threat_id", "both", "n_alerts", "open_key", "group_key")
    )
    threats = heads.join(
        candidates.withColumnRenamed("alert_id", "threat_id"), ["capture_id", "threat_id"]
    ).select(
        "capture_id",
        "threat_id",
        "category",
        F.when(F.col("both"), F.least(F.col("severity_score") + BOTH_BONUS, F.lit(100)))
        .otherwise(F.col("severity_score"))
        .alias("severity_score"),
        "severity_label",
        "title",
        "description",
        F.when(F.col("both"), "both").otherwise(F.col("detection_method")).alias(
            "detection_method"
        ),
        "source_ip",
        "n_source_ips",
        time_range().alias("time_range"),
        "first_us",
        "last_us",
        "n_alerts",
        "group_key",
        "open_key",
    )
    owner = kept.join(per_threat.select(*by_threat, "threat_id"), by_threat).select(
        "capture_id", "alert_id", "threat_id", "leads"
    )
    if durable:
        threats, owner = scratch_table(threats, "threats"), scratch_table(owner, "owners")
    return Threats(
        threats,
        members.join(owner, ["capture_id", "alert_id"])
        .select("capture_id", "threat_id", "role", "value")
        .distinct(),
        merged_evidence(candidates, owner),
    )


def merged_evidence(candidates: DataFrame, owner: DataFrame) -> DataFrame:
    """Evidence entries per threat; on equal keys the leading alert wins, then the earlier one."""
    entries = F.explode(F.from_json("evidence", "map<string,string>")).alias("key", "value")
    rows = candidates.select("capture_id", "alert_id", "ord_key", entries).join(
        owner, ["capture_id", "alert_id"]
    )
    precedence = F.concat(F.when(F.col("leads"), "0").otherwise("1"), "ord_key")
    return rows.groupBy("capture_id", "threat_id", "key").agg(
        F.min_by("value", precedence).alias("value")
    )


def ordered(threats: DataFrame) -> DataFrame:
    """Highest score first; ties in order of arrival."""
    return threats.orderBy("capture_id", F.desc("severity_score"), "group_key", "open_key")
