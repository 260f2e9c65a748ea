"""Window features on hand-made packets."""

import pytest
from pyspark.sql import functions as F

from made_rows import T0, log, packet
from wirelens.operators import features, summaries


def test_values_and_empty_windows(traffic):
    rows = [
        packet(0, 0.0, size=100, dport=80, flags=["SYN"]),
        packet(1, 1.0, size=50, dport=443, flags=["SYN", "ACK"], dst="203.0.113.1"),
        packet(2, 59.999999, size=1500, dport=80, proto="ICMP", flags=[]),
        packet(3, 125.0, size=10, dport=53, proto="DNS", flags=[], src="10.0.0.6"),
    ]
    logs = [log(0, 10.0), log(1, 70.0), log(2, 126.0, severity="medium"), log(3, 127.0, severity="low")]
    got = features.window_features(traffic(rows, logs)).orderBy("w").collect()
    assert [r["w"] for r in got] == [0, 1, 2]
    assert [r["window_start_us"] - T0 for r in got] == [0, 60_000_000, 120_000_000]
    first = got[0].asDict()
    expected = {
        "packets_per_second": 3 / 60, "unique_dst_ips": 2, "unique_dst_ports": 2,
        "syn_ratio": 2 / 3, "rst_ratio": 0, "icmp_ratio": 1 / 3, "avg_packet_size": 550,
        "packet_size_std": 672.0615, "small_packet_ratio": 1 / 3, "large_packet_ratio": 1 / 3,
        "unique_src_ips": 1, "tcp_flag_entropy": 0.918296, "port_entropy": 0.918296,
        "dns_query_count": 0, "http_error_count": 1, "bytes_per_second": 27.5,
        "connection_count": 2, "avg_flow_packets": 1.5,
    }
    for name, value in expected.items():
        assert first[name] == pytest.approx(value, abs=1e-3), name
    # A window without packets is all zero, even if a log entry falls into it.
    assert all(got[1][name] == 0.0 for name in features.FEATURE_NAMES)
    assert got[2]["dns_query_count"] == 1 and got[2]["http_error_count"] == 1
    assert got[2]["packet_size_std"] == 0 and got[2]["port_entropy"] == 0


def test_no_packets(spark, traffic):
    got = features.window_features(traffic([]))
    assert got.count() == 0 and len(got.columns) == 3 + 18


def test_longer_windows(traffic):
    rows = [packet(i, i * 20.0) for i in range(10)]
    assert features.window_features(traffic(rows), 300).count() == 1


def test_many_captures_equal_each_alone(traffic):
    rows = [packet(i, i * 7.0, dport=80 + i % 3, size=40 + i) for i in range(40)]
    other = [("d", *packet(i, i * 11.0, dport=22)[1:]) for i in range(20)]
    both = features.window_features(traffic(rows + other))
    alone = features.window_features(traffic(rows))
    assert sorted(both.filter("capture_id = 'c'").collect()) == sorted(alone.collect())


def test_baseline_counts_empty_windows(traffic):
    rows = [packet(0, 0.0), packet(1, 125.0)]
    stats = features.baseline_stats(features.window_features(traffic(rows))).first()
    assert stats["packets_per_second"] == pytest.approx(2 / 60 / 3)


def test_timeline_bands(spark, traffic):
    windows = features.window_features(traffic([packet(i, i * 60.0) for i in range(4)]))
    scores = spark.createDataFrame(
        [("c", 0, 0.9), ("c", 1, 0.5), ("c", 2, 0.4)], "capture_id string, w bigint, anomaly_score double"
    )
    got = features.timeline(windows, scores).orderBy("w").collect()
    assert [r["highlighted"] for r in got] == [True, False, False, False]
    assert [r["band"] for r in got] == ["critical", "high", "low", None]


def test_capture_summary_exact_and_approximate(traffic):
    rows = [packet(0, 5.0, src="10.0.0.1", dst="10.0.0.2"), packet(1, 1.0, src="10.0.0.2", dst="10.0.0.1")]
    t = traffic(rows)
    exact = summaries.capture_summary(t).first()
    assert exact["unique_ips"] == 4  # each address counts in both roles
    assert exact["time_range"] == "2026-03-15T10:00:05+00:00 – 2026-03-15T10:00:01+00:00"
    assert summaries.capture_summary(t, approximate=True).first()["unique_ips"] == 4


def test_summary_names_the_files(traffic):
    rows = [packet(), packet(1, capture_id="/data/in/b.pcap")]
    found = {r.capture_id: r.source_files for r in summaries.capture_summary(traffic(rows, [log()])).collect()}
    assert found == {"c": "c, f", "/data/in/b.pcap": "b.pcap"}


def test_summary_of_prepared_traffic_reads_what_the_rules_keep(traffic):
    """Neither packets nor log lines are gone through again; entries below `info` count, too."""
    rows = [packet(i, i % 7 * 50.0, src=f"10.0.0.{i % 3}", proto=("TCP", "UDP")[i % 2]) for i in range(40)]
    t = traffic(rows, [log(i, i, severity=("high", "info")[i % 2]) for i in range(5)])
    plain, prepared = summaries.capture_summary(t), summaries.capture_summary(t.prepared())
    assert prepared.collect() == plain.collect() and plain.first()["log_entries"] == 5
    tables = {path.split("/")[-2].rpartition("-")[0] for path in prepared.inputFiles()}
    assert tables == {"contacts", "entries"}


def test_hosts_and_their_networks(traffic):
    rows = [
        packet(0, 0.0, src="10.1.2.3", dst="9.9.9.9", dport=80, flags=["SYN"]),
        packet(1, 1.0, src="10.1.2.4", dst="9.9.9.9", dport=81),
        packet(2, 2.0, src="10.1.9.3", dst="9.9.9.8", dport=80),
        packet(3, 70.0, src="10.1.2.3", dst="9.9.9.9", dport=80),
    ]
    found = {
        (r.w, r.prefix, r.entity): (r.packets, r.syn_packets, r.hosts, r.unique_dst_ips, r.unique_dst_ports)
        for r in features.entity_features(traffic(rows)).collect()
    }
    assert len(found) == 3 + 2 + 1 + 3
    assert found[0, 32, "10.1.2.3"] == (1, 1, 1, 1, 1)
    assert found[0, 24, "10.1.2"] == (2, 2, 2, 1, 2)
    assert found[0, 16, "10.1"] == (3, 3, 3, 2, 2)
    assert found[1, 16, "10.1"] == (1, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        features.entity_features(traffic(rows), prefixes=(20,))


def test_sketches_merge_as_one_over_everything(spark):
    many = spark.range(40_000).selectExpr(
        "concat('c', id % 2) as capture_id", f"{T0} + id * 6000000 as ts_us",
        "concat('10.', id % 7, '.', id % 250, '.', id div 250 % 200) as src_ip", "concat('9.9.', id % 90, '.1') as dst_ip",
    )
    days = summaries.address_sketches(many)
    assert days.count() > 4
    (merged,) = summaries.sketched_distincts(summaries.merged_sketches(days.withColumn("all", F.lit(1)), "all")).collect()
    at_once = summaries.address_sketches(many.withColumns({"capture_id": F.lit("c"), "ts_us": F.lit(T0)}))
    (whole,) = summaries.sketched_distincts(summaries.merged_sketches(at_once, "capture_id")).collect()
    assert merged.packets == 40_000 and merged.unique_src_ips == whole.unique_src_ips
    exact = many.select("src_ip").distinct().count()
    assert abs(merged.unique_src_ips - exact) <= 0.05 * exact and merged.unique_dst_ips == 90
