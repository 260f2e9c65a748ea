"""Streaming forms that aggregations express: floods, features, flows.

Distinct counts are exact: one aggregation per (window, keys), and a second one on top of it. Windows
are aligned to the epoch (`offset` shifts them), as a stream has no first packet to count from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.features import ERROR_SEVERITIES, FEATURE_NAMES
from wirelens.operators.flows import FLOW_KEY
from wirelens.operators.floods import KINDS, WINDOW_SECONDS, _belongs
from wirelens.schemas import FLAG_NAMES
from wirelens.streaming.sources import LATENESS, timed


def flood_stream(
    packets: DataFrame,
    lateness: str = LATENESS,
    offset: str = "0 seconds",
    closing: DataFrame | None = None,
) -> DataFrame:
    """(capture_id, rule_name, window_start, dst_ip, packets, sources, rate) of floods."""
    window = F.window("ts", f"{WINDOW_SECONDS} seconds", startTime=offset)
    relevant = reduce(lambda a, b: a | b, [_belongs(kind) for kind in KINDS])
    per_source = (
        timed(packets.filter(relevant), lateness, closing)
        .groupBy("capture_id", window.alias("window"), "dst_ip", "src_ip")
        .agg(*[F.count_if(_belongs(kind)).alias(f"n_{kind}") for kind in KINDS])
    )
    per_target = per_source.groupBy("capture_id", "window", "dst_ip").agg(
        *[F.sum(f"n_{kind}").alias(f"{kind}_n") for kind in KINDS],
        *[F.count_if(F.col(f"n_{kind}") > 0).alias(f"{kind}_src") for kind in KINDS],
    )
    rows = F.array(
        *[
            F.when(
                (F.col(f"{kind}_n") > above) & (F.col(f"{kind}_src") > sources),
                F.struct(
                    F.lit(f"{kind}_flood").alias("rule_name"),
                    F.col(f"{kind}_n").alias("packets"),
                    F.col(f"{kind}_src").alias("sources"),
                ),
            )
            for kind, (_, above, sources) in KINDS.items()
        ]
    )
    return (
        per_target.select(
            "capture_id", F.col("window.start").alias("window_start"), "dst_ip", F.explode(rows).alias("r")
        )
        .filter(F.col("r").isNotNull())
        .select(
            "capture_id",
            "r.rule_name",
            "window_start",
            "dst_ip",
            "r.packets",
            "r.sources",
            (F.col("r.packets") / WINDOW_SECONDS).alias("rate"),
        )
    )


def _entropy_of(counts: list) -> F.Column:
    """Base-2 entropy of a fixed list of counts; zero for at most one occurrence."""
    total = reduce(lambda x, y: x + y, counts)
    weighted = reduce(
        lambda x, y: x + y, [F.when(c > 0, c * F.log2(c)).otherwise(0.0) for c in counts]
    )
    value = F.when(total > 1, F.log2(total) - weighted / total)
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def _packet_feature_stream(
    packets: DataFrame, window_seconds: int, lateness: str, closing: DataFrame | None
) -> DataFrame:
    window = F.window("ts", f"{window_seconds} seconds")
    flags = {f"flag_{name}": F.array_contains("tcp_flags", name) for name in FLAG_NAMES.values()}
    tests = {
        **flags,
        "n_icmp": F.col("protocol") == "ICMP",
        "n_dns": F.col("protocol") == "DNS",
        "n_small": F.col("size") < 100,
        "n_large": F.col("size") > 1400,
    }
    base = (
        timed(packets, lateness, closing)
        .groupBy("capture_id", window.alias("window"), "src_ip", "dst_ip", "dst_port")
        .agg(
            F.count("*").alias("n"),
            F.sum("size").alias("bytes"),
            F.sum((F.col("size").cast("bigint") * F.col("size")).cast("decimal(38,0)")).alias("squares"),
            *[F.count_if(test).alias(name) for name, test in tests.items()],
        )
    )

    def facet(kind: str, value) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    facets = F.array(
        facet("all", F.lit(None)),
        facet("src", F.col("src_ip")),
        facet("dst", F.col("dst_ip")),
        facet("port", F.col("dst_port")),
    )
    counts = ["n", "bytes", "squares", *tests]
    per_value = (
        base.select("capture_id", "window", F.explode(facets).alias("f"), *counts)
        .groupBy("capture_id", "window", "f.kind", "f.value")
        .agg(*[F.sum(c).alias(c) for c in counts], F.count("*").alias("connections"))
    )
    is_all, is_port = F.col("kind") == "all", F.col("kind") == "port"
    port_n = F.when(is_port, F.col("n"))
    merged = per_value.groupBy("capture_id", "window").agg(
        *[F.max(F.when(is_all, F.col(c))).alias(c) for c in (*counts, "connections")],
        F.count_if(F.col("kind") == "src").alias("unique_src_ips"),
        F.count_if(F.col("kind") == "dst").alias("unique_dst_ips"),
        F.count_if(is_port).alias("unique_dst_ports"),
        F.sum(port_n * F.log2(port_n)).alias("weighted"),
    )
    n = F.col("n")
    n_dec, bytes_dec = n.cast("decimal(19,0)"), F.col("bytes").cast("decimal(19,0)")
    spread = (n_dec * F.col("squares") - bytes_dec * bytes_dec).cast("double")
    return merged.select(
        "capture_id",
        "window",
        (n / window_seconds).alias("packets_per_second"),
        (F.col("bytes") / window_seconds).alias("bytes_per_second"),
        "unique_src_ips",
        "unique_dst_ips",
        "unique_dst_ports",
        (F.col("flag_SYN") / n).alias("syn_ratio"),
        (F.col("flag_RST") / n).alias("rst_ratio"),
        (F.col("n_icmp") / n).alias("icmp_ratio"),
        F.col("n_dns").alias("dns_query_count"),
        (F.col("bytes") / n).alias("avg_packet_size"),
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("packet_size_std"),
        (F.col("n_small") / n).alias("small_packet_ratio"),
        (F.col("n_large") / n).alias("large_packet_ratio"),
        _entropy_of([F.col(name) for name in flags]).alias("tcp_flag_entropy"),
        F.greatest(F.log2(n) - F.col("weighted") / n, F.lit(0.0)).alias("port_entropy"),
        F.col("connections").alias("connection_count"),
        (n / F.col("connections")).alias("avg_flow_packets"),
    )


def feature_stream(
    packets: DataFrame,
    window_seconds: int = 60,
    lateness: str = LATENESS,
    logs: DataFrame | None = None,
    closing: DataFrame | None = None,
) -> DataFrame:
    """The features of each window with packets or troubled log entries, as (capture_id, window_start, 18 doubles).

    Packets and `logs` are counted per window on their own, each with its watermark, and the windows of both are
    joined once both watermarks have passed them. As in batch, a window without packets is all zero; one
    without entries has no errors.
    """
    packet_side = _packet_feature_stream(packets, window_seconds, lateness, closing)
    zero = F.lit(0.0)
    if logs is None:
        joined = packet_side.select("*", zero.alias("http_error_count"))
    else:
        failing = logs.filter(F.col("ts_us").isNotNull() & F.col("severity").isin(ERROR_SEVERITIES))
        errors = (
            timed(failing.select("capture_id", "ts_us"), lateness, closing)
            .groupBy("capture_id", F.window("ts", f"{window_seconds} seconds").alias("window"))
            .agg(F.count("*").alias("http_error_count"))
        )
        joined = packet_side.join(errors, ["capture_id", "window"], "full_outer")
    occupied = F.col("packets_per_second").isNotNull()
    return joined.select(
        "capture_id",
        F.col("window.start").alias("window_start"),
        *[
            F.when(occupied, F.coalesce(F.col(name).cast("double"), zero)).otherwise(zero).alias(name)
            for name in FEATURE_NAMES
        ],
    )


def flow_stream(
    packets: DataFrame,
    idle: str = "5 minutes",
    lateness: str = LATENESS,
    closing: DataFrame | None = None,
) -> DataFrame:
    """Flows that end after an idle time; a stream needs a rule for when a flow is over."""
    return (
        timed(packets, lateness, closing)
        .groupBy(*FLOW_KEY, F.session_window("ts", idle).alias("session"))
        .agg(
            F.count("*").alias("packet_count"),
            F.sum("size").alias("total_bytes"),
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("end_us"),
        )
        .drop("session")
    )
