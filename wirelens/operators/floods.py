"""Floods: packets per destination in ten-second windows counted from the capture's origin.

All four kinds share one aggregation. Rows are first counted per (window, destination, source), so a
hot target is spread over its sources before it is brought together.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.functions.text import json_of, rounded
from wirelens.operators.alerts import Detector, Group, alert_rows, member_rows
from wirelens.plans.traffic import Traffic

CATEGORY = "DDOS_ATTACK"
WINDOW_SECONDS = 10

# Fixed values per kind: severity, packets above, sources above.
KINDS = {
    "syn": ("critical", 100, 5),
    "udp": ("critical", 500, 0),
    "icmp": ("high", 50, 0),
    "http": ("critical", 100, 5),
}


def _belongs(kind: str):
    return {
        "syn": net.is_syn_only,
        "udp": lambda: net.is_protocol("UDP"),
        "icmp": lambda: net.is_protocol("ICMP"),
        "http": net.is_web,
    }[kind]()


def flood_details(
    traffic: Traffic,
    kinds: tuple[str, ...] = tuple(KINDS),
    window_seconds: int = WINDOW_SECONDS,
    **_,
) -> DataFrame:
    relevant = reduce(lambda a, b: a | b, [_belongs(kind) for kind in kinds])
    counts = [F.count_if(_belongs(kind)).alias(f"n_{kind}") for kind in kinds]
    packets = traffic.packets.filter(relevant)
    return (
        traffic.anchored(packets, window_seconds * 1_000_000)
        .groupBy("capture_id", "w", "origin_us", "dst_ip", "src_ip")
        .agg(*counts)
    )


def _description(kind: str):
    sources = "%s flood targeting %s: %s %s from %d sources"
    plain = "%s flood targeting %s: %s %s"
    unit = "req/s" if kind == "http" else "pkt/s"
    values = [F.lit(kind.upper()), F.col("dst_ip"), F.col("rate").cast("string"), F.lit(unit)]
    if kind in ("syn", "http"):
        return F.format_string(sources, *values, F.col("src_n"))
    return F.format_string(plain, *values)


def _evidence(kind: str):
    fields = {"flood_type": F.lit(kind)}
    fields["request_rate" if kind == "http" else "packets_per_second"] = F.col("rate")
    if kind in ("syn", "http"):
        fields["source_count"] = F.col("src_n")
    if kind != "http":
        fields["target"] = F.col("dst_ip")
    return json_of(**fields)


def flood_alerts(
    details: DataFrame,
    kinds: tuple[str, ...] = tuple(KINDS),
    window_seconds: int = WINDOW_SECONDS,
    limits: dict | None = None,
    **_,
) -> DataFrame:
    limits = {**KINDS, **(limits or {})}
    aggs = []
    for kind in kinds:
        source = F.when(F.col(f"n_{kind}") > 0, F.col("src_ip"))
        x, y = net.set_signature(source)
        aggs += [
            F.sum(f"n_{kind}").alias(f"{kind}_total"),
            F.count(source).alias(f"{kind}_n"),
            F.min(source).alias(f"{kind}_first"),
            x.alias(f"{kind}_x"),
            y.alias(f"{kind}_y"),
        ]
    reached = [
        (F.col(f"{kind}_total") > limits[kind][1]) & (F.col(f"{kind}_n") > limits[kind][2])
        for kind in kinds
    ]
    targets = (
        details.groupBy("capture_id", "w", "origin_us", "dst_ip")
        .agg(*aggs)
        .filter(reduce(lambda a, b: a | b, reached))
    )
    kind_rows = [
        F.when(
            test,
            F.struct(
                F.lit(kind).alias("kind"),
                *[
                    F.col(f"{kind}_{c}").alias(f"src_{c}")
                    for c in ("total", "n", "first", "x", "y")
                ],
            ),
        )
        for kind, test in zip(kinds, reached)
    ]
    # One row per kind reached, from the one aggregation.
    hits = (
        targets.select(
            "capture_id", "w", "origin_us", "dst_ip", F.explode(F.array(*kind_rows)).alias("h")
        )
        .filter(F.col("h").isNotNull())
        .select("capture_id", "w", "origin_us", "dst_ip", "h.*")
        .withColumns(
            {
                "rate": rounded(F.col("src_total") / window_seconds, 1),
                "start_us": F.col("origin_us") + F.col("w") * (window_seconds * 1_000_000),
            }
        )
    )
    per_kind = [
        alert_rows(
            hits.filter(F.col("kind") == kind),
            f"{kind}_flood",
            limits[kind][0],
            CATEGORY,
            ["dst_ip", "start_us"],
            _description(kind),
            Group.read("src"),
            Group.of_one("dst_ip"),
            "start_us",
            "start_us",
            _evidence(kind),
        )
        for kind in kinds
    ]
    return reduce(DataFrame.unionByName, per_kind)


def flood_members(
    details: DataFrame,
    alerts: DataFrame,
    kinds: tuple[str, ...] = tuple(KINDS),
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    start = F.col("origin_us") + F.col("w") * (window_seconds * 1_000_000)
    named = [
        F.when(
            F.col(f"n_{kind}") > 0,
            F.concat_ws("|", F.lit(f"{kind}_flood"), "dst_ip", start.cast("string")),
        )
        for kind in kinds
    ]
    wanted = alerts.filter(F.col("n_source_ips") > 1).select("capture_id", "alert_id")
    rows = details.select(
        "capture_id", "src_ip", F.explode(F.array(*named)).alias("alert_id")
    ).filter(F.col("alert_id").isNotNull())
    return member_rows(rows.join(wanted, ["capture_id", "alert_id"], "left_semi"), "source_ip", "src_ip")


def one_kind(kind: str) -> Detector:
    kinds = (kind,)
    return Detector(
        f"{kind}_flood",
        partial(flood_details, kinds=kinds),
        partial(flood_alerts, kinds=kinds),
        partial(flood_members, kinds=kinds),
    )


FLOODS = Detector("floods", flood_details, flood_alerts, flood_members, costly=True)
