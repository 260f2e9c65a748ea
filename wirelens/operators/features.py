"""Eighteen traffic features per window, for any number of captures.

One pass over the packets counts them per (window, source, destination, port). Everything else,
including the distinct counts and the port entropy, is made from those rows by grouping sets, so no
hot window meets its raw packets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.plans.traffic import Traffic
from wirelens.schemas import FLAG_NAMES

# The features in their order, and the log severities that count as errors.
FEATURE_NAMES = [
    "packets_per_second",
    "unique_dst_ips",
    "unique_dst_ports",
    "syn_ratio",
    "rst_ratio",
    "icmp_ratio",
    "avg_packet_size",
    "packet_size_std",
    "small_packet_ratio",
    "large_packet_ratio",
    "unique_src_ips",
    "tcp_flag_entropy",
    "port_entropy",
    "dns_query_count",
    "http_error_count",
    "bytes_per_second",
    "connection_count",
    "avg_flow_packets",
]
ERROR_SEVERITIES = ["medium", "high", "critical"]

FLAGS = list(FLAG_NAMES.values())
_COUNTS = {
    "n": "1",
    "bytes": "size",
    **{f"n_{flag}": f"if(array_contains(tcp_flags, '{flag}'), 1, 0)" for flag in FLAGS},
    "n_icmp": "if(protocol = 'ICMP', 1, 0)",
    "n_dns": "if(protocol = 'DNS', 1, 0)",
    "n_small": "if(size < 100, 1, 0)",
    "n_large": "if(size > 1400, 1, 0)",
}


def _entropy(n: Column, weighted_logs: Column) -> Column:
    """Base-2 entropy from the total n and the sum of c*log2(c); zero for at most one value."""
    value = F.log2(n) - weighted_logs / n
    return F.when(n > 1, F.greatest(value, F.lit(0.0))).otherwise(0.0)


def _packet_features(packets: DataFrame, window_seconds: int) -> DataFrame:
    base = packets.groupBy("capture_id", "w", "src_ip", "dst_ip", "dst_port").agg(
        *[F.expr(f"sum({value})").alias(name) for name, value in _COUNTS.items()],
        F.expr("sum(cast(size as bigint) * size)").alias("squares"),
    )
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    key = [F.col("capture_id"), F.col("w")]
    sets = [
        [*key, F.col("src_ip")],
        [*key, F.col("dst_ip")],
        [*key, F.col("dst_port")],
        key,
    ]
    facets = base.groupingSets(
        sets, "capture_id", "w", "src_ip", "dst_ip", "dst_port"
    ).agg(
        F.grouping_id().alias("gid"),
        *sums,
        F.sum(F.col("squares").cast("decimal(38,0)")).alias("squares"),
        F.count("*").alias("connections"),
    )
    # Grouping ids, bits being (src_ip, dst_ip, dst_port) grouped away.
    by_src, by_dst, by_port, whole = 0b011, 0b101, 0b110, 0b111
    gid = F.col("gid")
    is_whole = gid == whole
    port_n = F.when(gid == by_port, F.col("n"))
    merged = facets.groupBy("capture_id", "w").agg(
        *[F.max(F.when(is_whole, F.col(c))).alias(c) for c in _COUNTS],
        F.max(F.when(is_whole, F.col("squares"))).alias("squares"),
        F.max(F.when(is_whole, F.col("connections"))).alias("connections"),
        F.count_if(gid == by_src).alias("srcs"),
        F.count_if(gid == by_dst).alias("dsts"),
        F.count_if(gid == by_port).alias("ports"),
        F.sum(port_n * F.log2(port_n)).alias("weighted_ports"),
    )
    n, size = F.col("n"), F.col("bytes")
    n_dec, bytes_dec = n.cast("decimal(19,0)"), size.cast("decimal(19,0)")
    spread = (n_dec * F.col("squares") - bytes_dec * bytes_dec).cast("double")
    values = {
        "packets_per_second": n / F.lit(window_seconds),
        "unique_dst_ips": F.col("dsts"),
        "unique_dst_ports": F.col("ports"),
        "syn_ratio": F.col("n_SYN") / n,
        "rst_ratio": F.col("n_RST") / n,
        "icmp_ratio": F.col("n_icmp") / n,
        "avg_packet_size": size / n,
        "packet_size_std": F.sqrt(F.greatest(spread, F.lit(0.0))) / n,
        "small_packet_ratio": F.col("n_small") / n,
        "large_packet_ratio": F.col("n_large") / n,
        "unique_src_ips": F.col("srcs"),
        "tcp_flag_entropy": _entropy(
            sum((F.col(f"n_{flag}") for flag in FLAGS), F.lit(0)),
            sum((F.when(F.col(f"n_{flag}") > 0, F.col(f"n_{flag}") * F.log2(f"n_{flag}")).otherwise(0.0) for flag in FLAGS), F.lit(0.0)),
        ),
        "port_entropy": _entropy(n, F.col("weighted_ports")),
        "dns_query_count": F.col("n_dns"),
        "bytes_per_second": size / F.lit(window_seconds),
        "connection_count": F.col("connections"),
        "avg_flow_packets": n / F.col("connections"),
    }
    return merged.select("capture_id", "w", *[v.alias(k) for k, v in values.items()])


def window_spine(traffic: Traffic, window_seconds: int = 60) -> DataFrame:
    """Every window of every capture from its first to its last packet, occupied or not."""
    width = window_seconds * 1_000_000
    last = F.expr(f"(end_us - origin_us) div {width}")
    return traffic.origins.select(
        "capture_id", "origin_us", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("w")
    ).select("capture_id", "w", (F.col("origin_us") + F.col("w") * width).alias("window_start_us"))


def window_features(traffic: Traffic, window_seconds: int = 60) -> DataFrame:
    """(capture_id, w, window_start_us, 18 doubles); windows without packets are all zero.

    The flag entropy is over the six flags of the schema.
    """
    width = window_seconds * 1_000_000
    packets = traffic.anchored(traffic.packets, width)
    joined = (
        window_spine(traffic, window_seconds)
        .join(_packet_features(packets, window_seconds), ["capture_id", "w"], "left")
    )
    if traffic.logs is not None:
        failing = traffic.troubles.filter(F.col("severity").isin(ERROR_SEVERITIES))
        errors = (
            traffic.anchored(failing, width)
            .groupBy("capture_id", "w")
            .agg(F.count("*").alias("http_error_count"))
        )
        joined = joined.join(errors, ["capture_id", "w"], "left")
    else:
        joined = joined.withColumn("http_error_count", F.lit(0))
    occupied = F.col("packets_per_second").isNotNull()
    return joined.select(
        "capture_id",
        "w",
        "window_start_us",
        *[
            F.when(occupied, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
            .otherwise(0.0)
            .alias(name)
            for name in FEATURE_NAMES
        ],
    )


def baseline_stats(features: DataFrame) -> DataFrame:
    """Mean of each feature per capture over all windows, empty ones included."""
    return features.groupBy("capture_id").agg(*[F.avg(c).alias(c) for c in FEATURE_NAMES])


def feature_names() -> list[str]:
    return list(FEATURE_NAMES)


def timeline(features: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Packets per second over time, with the anomaly score, its highlight and colour band."""
    scores = anomalies.select("capture_id", "w", "anomaly_score")
    score = F.col("anomaly_score")
    return features.join(scores, ["capture_id", "w"], "left").select(
        "capture_id",
        "w",
        "window_start_us",
        "packets_per_second",
        "anomaly_score",
        F.coalesce(score > 0.5, F.lit(False)).alias("highlighted"),
        F.when(score > 0.7, "critical")
        .when(score > 0.4, "high")
        .when(score.isNotNull(), "low")
        .alias("band"),
    )


ENTITY_SUMS = {
    "packets": "1",
    "bytes": "size",
    "syn_packets": "if(array_contains(tcp_flags, 'SYN'), 1, 0)",
}
PREFIXES = (32, 24, 16, 8)


def _network(address: Column, prefix: int) -> Column:
    """The leading parts of a dotted address: of `prefix` bits, a multiple of eight."""
    return F.substring_index(address, ".", prefix // 8)


def entity_features(
    traffic: Traffic, window_seconds: int = 60, prefixes: tuple[int, ...] = (32, 24, 16)
) -> DataFrame:
    """Windows per sending host and per network of hosts: (capture_id, w, prefix, entity, counts).

    `entity` is the address, or its leading parts. Packets are counted once per (window, source, destination)
    and (window, source, port); each wider network is rolled up from the next narrower one, whose rows are fewer.
    """
    if not set(prefixes) <= set(PREFIXES):
        raise ValueError(f"prefixes are among {PREFIXES}")
    packets = traffic.anchored(traffic.packets, window_seconds * 1_000_000)
    key = ["capture_id", "w", "entity"]
    sums = [F.sum(c).alias(c) for c in ENTITY_SUMS]
    base = packets.groupBy("capture_id", "w", "src_ip", "dst_ip", "dst_port").agg(
        *[F.expr(f"sum({value})").alias(name) for name, value in ENTITY_SUMS.items()]
    )
    by_dst = base.groupBy("capture_id", "w", F.col("src_ip").alias("entity"), "dst_ip").agg(*sums)
    by_port = base.select("capture_id", "w", F.col("src_ip").alias("entity"), "dst_port").distinct()
    hosts = base.select("capture_id", "w", F.col("src_ip").alias("entity")).distinct().withColumn("hosts", F.lit(1))
    levels = []
    for prefix in sorted(prefixes, reverse=True):
        if prefix < 32:
            wider = _network(F.col("entity"), prefix).alias("entity")
            by_dst = by_dst.select("capture_id", "w", wider, "dst_ip", *ENTITY_SUMS).groupBy(*key, "dst_ip").agg(*sums)
            by_port = by_port.select("capture_id", "w", wider, "dst_port").distinct()
            hosts = hosts.select("capture_id", "w", wider, "hosts")
        hosts = hosts.groupBy(*key).agg(F.sum("hosts").alias("hosts"))
        levels.append(
            by_dst.groupBy(*key)
            .agg(*sums, F.count("*").alias("unique_dst_ips"))
            .join(by_port.groupBy(*key).agg(F.count("*").alias("unique_dst_ports")), key)
            .join(hosts, key)
            .select(
                "capture_id", "w", F.lit(prefix).alias("prefix"), "entity", *ENTITY_SUMS, "hosts", "unique_dst_ips",
                "unique_dst_ports",
            )
        )
    return reduce(DataFrame.unionByName, levels)
