"""Rules on hand-made traffic: one case at each threshold, and the scenarios each must find."""

import json

import pytest

from made_rows import T0, log, packet
from wirelens.plans import rules


def run(name, traffic, **params):
    return rules.run_rule(name, traffic, **params).collect()


def all_names(traffic):
    return sorted(r["rule_name"] for r in rules.run_rules(traffic).collect())


def ports(n, gap=1.0):
    return [packet(i, i * gap, dport=1 + i, flags=["SYN"]) for i in range(n)]


def test_ordinary_packets_raise_nothing(traffic):
    few = [packet(i, i * 20.0, sport=50000 + i, dport=443) for i in range(3)]
    assert all_names(traffic(few, [log(severity="info")])) == []


def test_scan_of_25_ports(traffic):
    t = traffic(ports(25))
    assert all_names(t) == ["beaconing", "syn_scan", "vertical_port_scan"]
    (row,) = run("vertical_port_scan", t)
    assert row["description"] == "Vertical port scan from 10.0.0.5 to 203.0.113.9: 25 ports in 24s"
    assert json.loads(row["evidence"])["ports_scanned"] == 25
    assert json.loads(run("syn_scan", t)[0]["evidence"]) == {
        "scan_type": "syn", "syn_ratio": 1.0, "packet_count": 25,
    }


@pytest.mark.parametrize("n,found", [(20, 0), (21, 1)])
def test_vertical_threshold(traffic, n, found):
    assert len(run("vertical_port_scan", traffic(ports(n)))) == found


@pytest.mark.parametrize("last_us,found", [(60_000_000, 1), (60_000_001, 0)])
def test_vertical_window_end_is_inclusive(traffic, last_us, found):
    rows = ports(20) + [packet(99, us=last_us, dport=999)]
    assert len(run("vertical_port_scan", traffic(rows))) == found


@pytest.mark.parametrize("n,found", [(10, 0), (11, 1)])
def test_horizontal_threshold(traffic, n, found):
    rows = [packet(i, i, dst=f"203.0.113.{i}", dport=22) for i in range(n)]
    got = run("horizontal_port_scan", traffic(rows))
    assert len(got) == found
    if found:
        assert got[0]["n_dest_ips"] == 11 and got[0]["dest_ip"] == "203.0.113.0"


@pytest.mark.parametrize("n,syn,found", [(20, 20, 0), (21, 21, 1), (25, 20, 0), (25, 21, 1)])
def test_syn_scan_needs_more_than_20_packets_and_four_fifths(traffic, n, syn, found):
    rows = [
        packet(i, i, dport=443, flags=["SYN"] if i < syn else ["ACK"], dst=f"203.0.113.{i % 3}")
        for i in range(n)
    ]
    assert len(run("syn_scan", traffic(rows))) == found


def test_syn_scan_time_range_is_by_arrival(traffic):
    rows = [packet(i, 100 - i, flags=["SYN"]) for i in range(21)]
    (row,) = run("syn_scan", traffic(rows))
    assert (row["first_us"], row["last_us"]) == (T0 + 100_000_000, T0 + 80_000_000)


def test_dns_packets_are_not_tcp(traffic):
    rows = [packet(i, i, proto="DNS", dport=53, flags=["SYN"]) for i in range(25)]
    assert run("syn_scan", traffic(rows)) == []


def test_xmas(traffic):
    rows = [packet(0, flags=["FIN", "PSH", "URG"]), packet(1, flags=["FIN", "PSH"])]
    (row,) = run("xmas_scan", traffic(rows))
    assert json.loads(row["evidence"])["packet_count"] == 1


@pytest.mark.parametrize("n,sources,found", [(100, 6, 0), (101, 6, 1), (101, 5, 0)])
def test_syn_flood(traffic, n, sources, found):
    rows = [
        packet(i, i * 0.05, src=f"198.51.100.{i % sources}", flags=["SYN"], dport=81)
        for i in range(n)
    ]
    got = run("syn_flood", traffic(rows))
    assert len(got) == found
    if found:
        assert got[0]["description"] == (
            "SYN flood targeting 203.0.113.9: 10.1 pkt/s from 6 sources"
        )


@pytest.mark.parametrize(
    "rule,n,proto,found",
    [
        ("udp_flood", 500, "UDP", 0),
        ("udp_flood", 501, "udp", 1),
        ("icmp_flood", 50, "ICMP", 0),
        ("icmp_flood", 51, "ICMP", 1),
    ],
)
def test_udp_and_icmp_floods(traffic, rule, n, proto, found):
    rows = [packet(i, i * 0.001, proto=proto, dport=9, flags=[]) for i in range(n)]
    assert len(run(rule, traffic(rows))) == found


def test_flood_windows_count_from_the_first_packet_of_the_capture(traffic):
    # 60 packets on each side of 10 s after the first packet: two windows, none above 100.
    rows = [packet(0, 3.0, dst="192.0.2.1", dport=9)]
    rows += [
        packet(1 + i, 8.0 + i * 0.0833, src=f"198.51.100.{i % 9}", dport=80, flags=["ACK"])
        for i in range(120)
    ]
    assert run("http_flood", traffic(rows)) == []
    shifted = rows[1:]  # now the first of them opens the window and all 120 are in it
    (row,) = run("http_flood", traffic(shifted))
    assert json.loads(row["evidence"])["request_rate"] == 12.0


def test_captures_are_independent(traffic):
    one = [packet(i, i * 0.05, src=f"198.51.100.{i % 9}", flags=["SYN"]) for i in range(60)]
    other = [(("d",) + p[1:]) for p in one]
    assert run("syn_flood", traffic(one + other)) == []


@pytest.mark.parametrize("n,found", [(4, 0), (5, 1)])
def test_ssh_brute_force_threshold(traffic, n, found):
    logs = [log(i, i * 5.0) for i in range(n)]
    got = run("ssh_brute_force", traffic([packet()], logs))
    assert len(got) == found
    if found:
        assert json.loads(got[0]["evidence"])["duration_seconds"] == 20.0


def test_ssh_six_attempts(traffic):
    logs = [log(i, i * 5.0) for i in range(6)]
    (row,) = run("ssh_brute_force", traffic([packet()], logs))
    assert row["description"] == (
        "SSH brute force from 198.51.100.7: 6 failed attempts in 25s"
    )
    assert row["n_dest_ips"] == 0 and row["dest_ip"] is None


@pytest.mark.parametrize("n,found", [(9, 0), (10, 1)])
def test_http_brute_force(traffic, n, found):
    logs = [
        log(i, i, message=f"POST /{'login' if i % 2 else 'Auth'}?u={i} failed", severity="medium",
            service="nginx")
        for i in range(n)
    ]
    got = run("http_brute_force", traffic([packet()], logs))
    assert len(got) == found
    if found:
        assert json.loads(got[0]["evidence"])["paths_targeted"] == 2


def test_no_logs_no_brute_force(traffic):
    assert run("ssh_brute_force", traffic([packet()])) == []


def test_malicious_port_counts_both_ends(traffic):
    rows = [packet(0, sport=4444, dport=4444), packet(1, 1.0, sport=4444, dport=80, src="10.0.0.6")]
    (row,) = run("malicious_port", traffic(rows))
    assert json.loads(row["evidence"])["connections"] == 3
    assert row["n_source_ips"] == 2


def test_malicious_port_from_indicator_table(spark, traffic):
    ports = spark.createDataFrame([(2222,)], "port int")
    got = run("malicious_port", traffic([packet(dport=2222), packet(1, dport=4444)]), indicators=ports)
    assert [r["alert_id"] for r in got] == ["malicious_port|2222"]


@pytest.mark.parametrize("n,found", [(5, 0), (6, 1), (8, 1)])
def test_beaconing(traffic, n, found):
    got = run("beaconing", traffic([packet(i, i * 10.0) for i in range(n)]))
    assert len(got) == found
    if found:
        assert json.loads(got[0]["evidence"])["std_deviation"] == 0.0
        assert "(avg interval 10.0s, std 0.0s)" in got[0]["description"]


def test_beaconing_minimum_interval(traffic):
    burst = traffic([packet(i, i * 0.001) for i in range(10)])
    assert len(run("beaconing", burst)) == 1
    assert run("beaconing", burst, min_mean_interval_s=1.0) == []


@pytest.mark.parametrize("size,found", [(10_000_000, 0), (10_000_001, 1)])
def test_exfiltration(traffic, size, found):
    got = run("data_exfiltration", traffic([packet(size=size)]))
    assert len(got) == found
    if found:
        assert "(10,000,001 bytes)" in got[0]["description"]
    assert run("data_exfiltration", traffic([packet(size=size, dst="10.1.1.1")])) == []


@pytest.mark.parametrize("n,found", [(100, 0), (101, 1), (150, 1)])
def test_dns_volume(traffic, n, found):
    rows = [packet(i, i * 0.2, proto="UDP", dport=53, flags=[]) for i in range(n)]
    got = run("dns_tunneling_volume", traffic(rows))
    assert len(got) == found
    if found:
        assert json.loads(got[0]["evidence"])["queries_in_window"] == n


def test_dns_volume_spread_out(traffic):
    rows = [packet(i, i * 1.0, proto="DNS", dport=53, flags=[]) for i in range(150)]
    assert run("dns_tunneling_volume", traffic(rows)) == []


@pytest.mark.parametrize("n,size,found", [(25, 200, 1), (20, 101, 1), (19, 200, 0), (25, 100, 0)])
def test_dns_oversized(traffic, n, size, found):
    rows = [packet(i, i * 9.0, proto="DNS", dport=53, flags=[], payload=size) for i in range(n)]
    got = run("dns_tunneling_oversized_queries", traffic(rows))
    assert len(got) == found
    if found:
        assert json.loads(got[0]["evidence"])["average_payload_bytes"] == float(size)


def test_alerts_are_ordered_by_severity(traffic):
    got = rules.run_rules(traffic(ports(25))).collect()
    assert [r["severity"] for r in got] == ["critical", "high", "medium"]


def test_order_and_partitioning_do_not_matter(traffic):
    rows = ports(30) + [packet(100 + i, i, dst=f"203.0.113.{i}", dport=22) for i in range(15)]
    one, two = traffic(rows), traffic(rows[::-1])
    two.packets = two.packets.repartition(7)
    first = rules.rule_results(one)
    second = rules.rule_results(two, durable=False)
    for a, b in zip(first, second):
        assert sorted(a.collect()) == sorted(b.collect())


def test_members_list_every_address(traffic):
    rows = [packet(i, i * 0.05, src=f"198.51.100.{i % 9}", flags=["SYN"]) for i in range(120)]
    members = rules.rule_results(traffic(rows)).members.filter("alert_id like 'syn_flood%'").collect()
    assert {m["value"] for m in members if m["role"] == "source_ip"} == {
        f"198.51.100.{i}" for i in range(9)
    }
    assert [m["value"] for m in members if m["role"] == "dest_ip"] == ["203.0.113.9"]


def test_user_rule_takes_part(traffic):
    def quiet(t):
        return t.packets.selectExpr(
            "capture_id", "'quiet|1' as alert_id", "'low' as severity",
            "'SUSPICIOUS_CONNECTION' as category", "'x' as description", "src_ip as source_ip",
            "ts_us as first_us", "ts_us as last_us",
        )

    rules.register_rule("quiet", quiet)
    try:
        names = all_names(traffic([packet()]))
    finally:
        rules.unregister_rule("quiet")
    assert names == ["quiet"]
