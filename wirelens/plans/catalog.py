"""Registered queries: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.functions.logs import request_path
from wirelens.operators import brute_force, classify, features, logs, reports, summaries
from wirelens.operators.anomaly import ensemble, lof, prepare, stored
from wirelens.operators.flows import build_flows
from wirelens.operators.time_windows import first_burst, gap_statistics
from wirelens.plans import rules
from wirelens.plans.traffic import MINUTE_US, Traffic
from wirelens.session import ON_RELEASE, adopt, scratch_folder, scratch_table, spread
from wirelens.sources import derived
from wirelens.sources.frames import decode_frames
from wirelens.streaming import aggregates, scoring, stateful
from wirelens.streaming.sources import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALERT_COLUMNS = [
    "capture_id",
    "alert_id",
    "rule_name",
    "severity",
    "category",
    "description",
    "source_ip",
    "n_source_ips",
    "dest_ip",
    "n_dest_ips",
    "first_us",
    "last_us",
    "evidence",
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs ---------------------------------------------------------------------------------


def packets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.packets_from_events(derived.events(spark, sf_dir))


def syslog_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.syslog_lines_from_events(spread(derived.events(spark, sf_dir)))
    return logs.parse_lines(lines, year=2024)


def access_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.access_lines_from_events(spread(derived.events(spark, sf_dir)))
    return logs.parse_lines(lines)


def both_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(derived.events(spark, sf_dir))
    return derived.syslog_lines_from_events(ev).unionByName(derived.access_lines_from_events(ev))


def traffic_of(spark: SparkSession, sf_dir: str, with_logs: bool = True) -> Traffic:
    return Traffic(packets_of(spark, sf_dir), syslog_of(spark, sf_dir) if with_logs else None)


_shared: dict[tuple, object] = {}
ON_RELEASE.append(_shared.clear)


def _once(name: str, spark: SparkSession, sf_dir: str, make):
    """Several report tables stand on the same threats; derive those once per application."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def prepared_of(spark: SparkSession, sf_dir: str) -> Traffic:
    """The traffic that all rules read, its packets written once instead of derived for each rule."""

    def make():
        found = traffic_of(spark, sf_dir)
        return Traffic(scratch_table(found.packets, "packets"), found.logs).prepared()

    return _once("prepared", spark, sf_dir, make)


def results_of(spark: SparkSession, sf_dir: str) -> rules.RuleResults:
    return _once("results", spark, sf_dir, lambda: rules.rule_results(prepared_of(spark, sf_dir)))


def threats_of(spark: SparkSession, sf_dir: str) -> classify.Threats:
    def make():
        found = results_of(spark, sf_dir)
        return classify.classify(found.alerts, found.members)

    return _once("threats", spark, sf_dir, make)


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        return scratch_table(features.window_features(traffic_of(spark, sf_dir)), "features")

    return _once("features", spark, sf_dir, make)


def votes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        scores = scratch_table(ensemble.model_scores(features_of(spark, sf_dir)), "scores")
        return scratch_table(ensemble.model_votes(scores), "votes")

    return _once("votes", spark, sf_dir, make)


def anomalies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.anomalies_from_votes(features_of(spark, sf_dir), votes_of(spark, sf_dir))


# --- packets --------------------------------------------------------------------------------


@query
def packet_table(spark, sf_dir):
    return packets_of(spark, sf_dir).withColumn("tcp_flags", F.array_join("tcp_flags", "|"))


@query
def decoded_labels(spark, sf_dir):
    """Protocol label and flag names of an already decoded table with flag letters."""
    p = packets_of(spark, sf_dir)
    letters = F.concat(
        F.array_join(F.transform("tcp_flags", lambda f: F.substring(f, 1, 1)), ""), F.lit("EC")
    )
    is_dns = F.col("protocol") == "DNS"
    label = net.protocol_label(
        is_dns, F.col("protocol") == "TCP", is_dns | (F.col("protocol") == "UDP"),
        F.col("protocol") == "ICMP",
    )
    return p.select(
        "seq", label.alias("protocol"), F.array_join(net.flag_names(letters), "|").alias("tcp_flags")
    )


@query
def packet_predicates(spark, sf_dir):
    tests = {
        "is_dns": net.is_dns(),
        "is_syn_only": net.is_syn_only(),
        "is_xmas": net.is_xmas(),
        "is_web": net.is_web(),
        "src_internal": net.is_internal_ip("src_ip"),
        "dst_internal": net.is_internal_ip("dst_ip"),
    }
    return packets_of(spark, sf_dir).select(
        "seq", *[t.cast("int").alias(name) for name, t in tests.items()]
    )


@query
def packet_filter(spark, sf_dir):
    chosen = net.packet_filter(
        protocols=["TCP"], dst_port=443, src="192.168.1.15", since_us=derived.EPOCH_US
    )
    return (
        packets_of(spark, sf_dir)
        .filter(chosen)
        .select("seq", "ts_us", "src_ip", "dst_ip", "dst_port", "size")
    )


@query
def flows(spark, sf_dir):
    return build_flows(packets_of(spark, sf_dir))


@query
def protocol_distribution(spark, sf_dir):
    return summaries.protocol_distribution(packets_of(spark, sf_dir))


@query
def protocol_breakdown(spark, sf_dir):
    return summaries.protocol_breakdown(packets_of(spark, sf_dir)).withColumn(
        "share_pct", F.round("share_pct", 6)
    )


@query
def top_ports(spark, sf_dir):
    return summaries.top_ports(packets_of(spark, sf_dir))


@query
def capture_summary(spark, sf_dir):
    return summaries.capture_summary(traffic_of(spark, sf_dir))


# --- logs -----------------------------------------------------------------------------------

LOG_COLUMNS = ["log_format", "ts_raw", "ts_us", "source_ip", "message", "severity", "service"]


@query
def syslog_entries(spark, sf_dir):
    return syslog_of(spark, sf_dir).select(F.col("seq.line").alias("line_no"), *LOG_COLUMNS)


@query
def access_entries(spark, sf_dir):
    return access_of(spark, sf_dir).select(F.col("seq.line").alias("line_no"), *LOG_COLUMNS)


@query
def detected_formats(spark, sf_dir):
    return logs.detect_format(both_lines(spark, sf_dir))


@query
def error_entries(spark, sf_dir):
    parsed = logs.parse_lines(both_lines(spark, sf_dir), year=2024)
    return logs.error_entries(parsed).select(
        F.col("seq.line").alias("line_no"), "source_file", "severity", "source_ip"
    )


@query
def mixed_file_entries(spark, sf_dir):
    """Both formats in one file, decided line by line."""
    lines = both_lines(spark, sf_dir).withColumn("source_file", F.lit("mixed"))
    return (
        logs.parse_lines(lines, year=2024, per_line=True)
        .groupBy("log_format", "severity", "service")
        .agg(F.count("*").alias("n"))
    )


@query
def log_summary(spark, sf_dir):
    return logs.log_summary(logs.parse_lines(both_lines(spark, sf_dir), year=2024))


@query
def login_request_paths(spark, sf_dir):
    return syslog_of(spark, sf_dir).filter(brute_force.is_login_attempt()).select(
        F.col("seq.line").alias("line_no"), "source_ip", request_path("message").alias("path")
    )


# --- window primitives ----------------------------------------------------------------------


@query
def anchored_windows(spark, sf_dir):
    traffic = traffic_of(spark, sf_dir, with_logs=False)
    return (
        traffic.anchored(traffic.packets, 10_000_000)
        .groupBy("capture_id", "w")
        .agg(F.count("*").alias("packets"))
    )


@query
def query_bursts(spark, sf_dir):
    dns = packets_of(spark, sf_dir).filter(net.is_dns()).select("capture_id", "src_ip", "ts_us")
    return first_burst(dns, ["capture_id", "src_ip"], 101, MINUTE_US)


@query
def pair_gaps(spark, sf_dir):
    pairs = gap_statistics(
        packets_of(spark, sf_dir).select("capture_id", "src_ip", "dst_ip", "ts_us"),
        ["capture_id", "src_ip", "dst_ip"],
    )
    return pairs.select(
        "capture_id",
        "src_ip",
        "dst_ip",
        "n",
        "first_us",
        "last_us",
        F.round(F.col("mean_gap_us") / 1e6, 5).alias("mean_gap_s"),
        F.round(F.col("std_gap_us") / 1e6, 5).alias("std_gap_s"),
    )


# --- features -------------------------------------------------------------------------------


@query
def window_features(spark, sf_dir):
    return features.window_features(traffic_of(spark, sf_dir)).select(
        "capture_id",
        "w",
        "window_start_us",
        *[F.round(c, 6).alias(c) for c in features.FEATURE_NAMES],
    )


@query
def baseline_stats(spark, sf_dir):
    stats = features.baseline_stats(features.window_features(traffic_of(spark, sf_dir)))
    return stats.select("capture_id", *[F.round(c, 6).alias(c) for c in features.FEATURE_NAMES])


@query
def entity_features(spark, sf_dir):
    """Windows of hosts and their networks."""
    return features.entity_features(traffic_of(spark, sf_dir, with_logs=False))


@query
def sketched_distincts(spark, sf_dir):
    """Distinct addresses per capture from sketches that were stored by day."""
    stored_days = scratch_table(summaries.address_sketches(packets_of(spark, sf_dir)), "sketches")
    return summaries.sketched_distincts(summaries.merged_sketches(stored_days, "capture_id"))


# --- rules ----------------------------------------------------------------------------------


def _rule_query(name: str) -> Query:
    def run(spark, sf_dir):
        needs_logs = rules.RULES[name].needs_logs
        return rules.run_rule(name, traffic_of(spark, sf_dir, needs_logs)).select(*ALERT_COLUMNS)

    run.__name__ = name
    return run


for _name in rules.RULES:
    query(_rule_query(_name))


@query
def all_alerts(spark, sf_dir):
    return rules.run_rules(traffic_of(spark, sf_dir)).select(*ALERT_COLUMNS, "severity_rank")


@query
def alert_members(spark, sf_dir):
    return results_of(spark, sf_dir).members


@query
def user_rule(spark, sf_dir):
    """A rule written as SQL by the user of the library."""
    name = "large_icmp"
    rules.register_rule(
        name,
        """select capture_id, concat('large_icmp|', src_ip) as alert_id, 'low' as severity,
             'SUSPICIOUS_CONNECTION' as category, concat('Large ICMP from ', src_ip) as description,
             src_ip as source_ip, min(ts_us) as first_us, max(ts_us) as last_us
           from {packets} where protocol = 'ICMP' and size > 400
           group by capture_id, src_ip""",
    )
    try:
        found = rules.user_alerts(name, traffic_of(spark, sf_dir, with_logs=False))
    finally:
        rules.unregister_rule(name)
    return found.select(
        "capture_id", "alert_id", "rule_name", "severity", "description", "first_us", "last_us"
    )


# --- anomaly vote ---------------------------------------------------------------------------


@query
def scaled_features(spark, sf_dir):
    windows = features.window_features(traffic_of(spark, sf_dir))
    rows = prepare.scaled_rows(windows, prepare.feature_stats(windows))
    return rows.select(
        "capture_id",
        "w",
        *[F.round(F.col("x")[i], 5).alias(c) for i, c in enumerate(features.FEATURE_NAMES)],
    )


@query
def outlier_factors(spark, sf_dir):
    windows = features_of(spark, sf_dir)
    stats = prepare.feature_stats(windows)
    rows = scratch_table(prepare.scaled_rows(windows, stats), "scaled")
    return lof.local_outlier_factor(rows, prepare.chunk_counts(stats)).select(
        "capture_id", "w", F.round("lof", 5).alias("lof")
    )


@query
def contributing_features(spark, sf_dir):
    windows = features_of(spark, sf_dir)
    return ensemble.contributing_features(windows, prepare.feature_stats(windows)).select(
        "capture_id", "w", F.array_join("contributing", ", ").alias("contributing")
    )


@query
def model_votes(spark, sf_dir):
    return votes_of(spark, sf_dir)


@query
def anomalies(spark, sf_dir):
    return anomalies_of(spark, sf_dir).select(
        "capture_id",
        "w",
        "start_us",
        "end_us",
        "anomaly_score",
        F.array_join("contributing", ", ").alias("contributing"),
        "agreement",
    )


@query
def traffic_timeline(spark, sf_dir):
    return features.timeline(features_of(spark, sf_dir), anomalies_of(spark, sf_dir))


@query
def threats_with_anomalies(spark, sf_dir):
    found = results_of(spark, sf_dir)
    merged = classify.classify(found.alerts, found.members, anomalies_of(spark, sf_dir))
    return classify.ordered(merged.threats)


# --- threats and reports --------------------------------------------------------------------

THREAT_COLUMNS = [
    "capture_id",
    "threat_id",
    "category",
    "severity_score",
    "severity_label",
    "title",
    "description",
    "detection_method",
    "source_ip",
    "n_source_ips",
    "time_range",
    "n_alerts",
    "group_key",
    "open_key",
]


@query
def threats(spark, sf_dir):
    return classify.ordered(threats_of(spark, sf_dir).threats).select(*THREAT_COLUMNS)


@query
def threats_whole_islands(spark, sf_dir):
    found = results_of(spark, sf_dir)
    merged = classify.classify(found.alerts, found.members, merge="whole_islands")
    return merged.threats.select("capture_id", "threat_id", "category", "severity_score", "n_alerts")


@query
def threat_members(spark, sf_dir):
    return threats_of(spark, sf_dir).members


@query
def threat_evidence(spark, sf_dir):
    return threats_of(spark, sf_dir).evidence


@query
def severity_counts(spark, sf_dir):
    return reports.severity_counts(threats_of(spark, sf_dir).threats)


@query
def executive_facts(spark, sf_dir):
    summary = summaries.capture_summary(prepared_of(spark, sf_dir))
    return reports.executive_facts(threats_of(spark, sf_dir).threats, summary)


TABLE_COLUMNS = [
    "capture_id", "threat_id", "severity", "category", "title", "source_ips", "detection",
]


@query
def threat_table(spark, sf_dir):
    t = threats_of(spark, sf_dir)
    return reports.threat_table(t.threats, t.members).select(*TABLE_COLUMNS)


@query
def compact_threat_table(spark, sf_dir):
    t = threats_of(spark, sf_dir)
    return reports.compact_threat_table(t.threats, t.members).select(*TABLE_COLUMNS)


@query
def critical_threats(spark, sf_dir):
    t = threats_of(spark, sf_dir)
    return reports.threat_table(t.threats, t.members, severities=["critical"]).select(
        *TABLE_COLUMNS
    )


@query
def threat_sources(spark, sf_dir):
    t = threats_of(spark, sf_dir)
    return reports.source_listing(t.threats, t.members)


@query
def recommendations(spark, sf_dir):
    return reports.prioritised_recommendations(threats_of(spark, sf_dir).threats)


@query
def top_threats(spark, sf_dir):
    return reports.top_threats(threats_of(spark, sf_dir).threats)


# --- raw frames -----------------------------------------------------------------------------


@query
def decoded_frames(spark, sf_dir):
    """Frames put together from the packets by SQL, and decoded again."""
    return decode_frames(derived.frames_from_packets(packets_of(spark, sf_dir))).withColumn(
        "tcp_flags", F.array_join("tcp_flags", "|")
    )


# --- streams --------------------------------------------------------------------------------


def packet_stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = derived.events(spark, sf_dir).schema
    landed = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return derived.packets_from_events(landed)


def log_stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = derived.events(spark, sf_dir).schema
    landed = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return logs.parse_lines(derived.syslog_lines_from_events(landed), year=2024, per_line=True)


@query
def streamed_floods(spark, sf_dir):
    adopt(spark)
    packets = packet_stream_of(spark, sf_dir)
    rows = replay(spark, lambda closing: aggregates.flood_stream(packets, closing=closing), "floods")
    return rows.withColumn("window_start", F.unix_micros("window_start"))


@query
def streamed_features(spark, sf_dir):
    adopt(spark)
    packets, entries = packet_stream_of(spark, sf_dir), log_stream_of(spark, sf_dir)
    rows = replay(
        spark, lambda closing: aggregates.feature_stream(packets, logs=entries, closing=closing), "features"
    )
    return rows.withColumns(
        {
            "window_start": F.unix_micros("window_start"),
            **{c: F.round(c, 6) for c in features.FEATURE_NAMES},
        }
    )


@query
def streamed_flows(spark, sf_dir):
    adopt(spark)
    packets = packet_stream_of(spark, sf_dir)
    return replay(spark, lambda closing: aggregates.flow_stream(packets, closing=closing), "flows")


@query
def streamed_scores(spark, sf_dir):
    """Windows of the streamed traffic by models that were trained on the batch features and published."""
    adopt(spark)
    path = f"{scratch_folder(spark)}/models-{uuid.uuid4().hex}"
    stored.publish(stored.train(features_of(spark, sf_dir)), path)
    packets, entries = packet_stream_of(spark, sf_dir), log_stream_of(spark, sf_dir)
    return scoring.replay_scores(
        spark,
        lambda closing: aggregates.feature_stream(packets, logs=entries, closing=closing),
        stored.load(spark, path),
    )


def _streamed_bursts(spark: SparkSession, events: DataFrame, source: str, threshold: int) -> DataFrame:
    return replay(
        spark, lambda closing: stateful.burst_stream(events, source, threshold, closing=closing), "bursts"
    )


@query
def streamed_query_bursts(spark, sf_dir):
    adopt(spark)
    return _streamed_bursts(spark, packet_stream_of(spark, sf_dir).filter(net.is_dns()), "src_ip", 101)


@query
def streamed_ssh_bursts(spark, sf_dir):
    adopt(spark)
    failed = log_stream_of(spark, sf_dir).filter(brute_force.is_failed_ssh_login())
    return _streamed_bursts(spark, failed, "source_ip", 5)


@query
def streamed_http_bursts(spark, sf_dir):
    adopt(spark)
    tried = log_stream_of(spark, sf_dir).filter(brute_force.is_login_attempt())
    return _streamed_bursts(spark, tried, "source_ip", 10)


def _streamed_scans(spark: SparkSession, sf_dir: str, keys: tuple[str, str], item: str, more_than: int):
    packets = packet_stream_of(spark, sf_dir)
    return replay(
        spark, lambda closing: stateful.scan_stream(packets, keys, item, more_than, closing=closing), "scans"
    )


@query
def streamed_vertical_scans(spark, sf_dir):
    adopt(spark)
    return _streamed_scans(spark, sf_dir, ("src_ip", "dst_ip"), "dst_port", 20)


@query
def streamed_horizontal_scans(spark, sf_dir):
    adopt(spark)
    found = _streamed_scans(spark, sf_dir, ("src_ip", "dst_port"), "dst_ip", 10)
    return found.withColumn("dst_port", F.col("dst_port").cast("int"))


@query
def streamed_beacons(spark, sf_dir):
    adopt(spark)
    packets = packet_stream_of(spark, sf_dir)
    rows = replay(spark, lambda closing: stateful.beacon_stream(packets, closing=closing), "beacons")
    latest = rows.groupBy("capture_id", "src_ip", "dst_ip").agg(
        F.max_by(F.struct("n", "first_us", "last_us", "mean_gap_us", "std_gap_us", "beacons"), "n").alias("r")
    )
    return latest.filter("r.beacons").select(
        "capture_id",
        "src_ip",
        "dst_ip",
        "r.n",
        "r.first_us",
        "r.last_us",
        F.round(F.col("r.mean_gap_us") / 1e6, 5).alias("mean_gap_s"),
        F.round(F.col("r.std_gap_us") / 1e6, 5).alias("std_gap_s"),
    )
