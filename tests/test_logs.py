"""Log lines: both formats, severities, formats per file, times, sinks."""

import pytest
from pyspark.sql import functions as F

from wirelens.functions import logs as L
from wirelens.functions import net
from wirelens.operators.logs import error_entries, log_summary, parse_lines
from wirelens.plans import rules
from wirelens.plans.traffic import Traffic
from wirelens.schemas import PACKETS, empty
from wirelens.sources import generated, tables

SYSLOG = [
    "Mar 15 10:00:01 gateway sshd[9901]: Failed password for root from 10.99.88.77 port 50000 ssh2",
    "Mar 15 10:00:02 webserver kernel: [4.5] eth0: link up at 1000 Mbps",
    "",
    "not a log line",
    "Mar  5 10:00:03 firewall app: segfault at 0",
    "Mar 15 10:00:04 firewall app: some Error happened",
    "Mar 15 10:00:05 firewall app: WARNING low disk",
    "Feb 30 10:00:06 firewall app: never",
]
ACCESS = [
    '192.168.1.10 - - [15/Mar/2026:10:00:01 +0100] "GET /about HTTP/1.1" 200 512 "-" "x"',
    '10.99.88.77 - - [15/Mar/2026:10:00:02 +0100] "GET /../etc/passwd HTTP/1.1" 403 287 "-" "x"',
    '203.0.113.50 - - [15/Mar/2026:10:00:03 +0100] "GET /wp-admin HTTP/1.1" 404 196 "-" "x"',
    '192.168.1.11 - - [15/Mar/2026:10:00:04 +0100] "GET / HTTP/1.1" 500 1 "-" "x"',
    '192.168.1.12 - - [15/Mar/2026:10:00:05 +0100] "POST /login HTTP/1.1" 304 - "-" "x"',
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "a.log").write_text("\n".join(["", "hello", *SYSLOG]))
    (folder / "b.log").write_bytes("\n".join(ACCESS).encode() + b"\n\xff\xfe broken bytes\n")
    return folder


def test_files_of_both_formats(spark, files):
    entries = tables.read_logs(spark, str(files), year=2026).cache()
    got = {(r["log_format"], r["raw_line"]): r for r in entries.collect()}
    assert len(got) == 10
    first = got["syslog", SYSLOG[0]]
    assert (first["source_ip"], first["service"], first["severity"]) == ("10.99.88.77", "sshd", "high")
    assert first["ts_us"] == 1773568801000000
    severities = [got["syslog", SYSLOG[i]]["severity"] for i in (1, 4, 5, 6)]
    assert severities == ["info", "critical", "medium", "low"]
    assert got["syslog", SYSLOG[1]]["source_ip"] == "webserver"
    assert got["syslog", SYSLOG[7]]["ts_us"] is None  # kept, but without a time
    access = [got["apache", line] for line in ACCESS[:4]]
    assert [r["severity"] for r in access] == ["info", "high", "low", "medium"]
    assert access[0]["message"] == "GET /about → 200" and access[0]["service"] == "httpd"
    assert access[0]["ts_us"] == 1773568801000000 - 3_600_000_000
    assert error_entries(entries).count() == 4
    summary = {r["log_format"]: r for r in log_summary(entries).collect()}
    assert summary["syslog"]["time_range"] == "Mar 15 10:00:01 – Feb 30 10:00:06"
    assert summary["apache"]["error_count"] == 2


def test_zone_and_year_are_options(spark, files):
    entries = tables.read_logs(spark, str(files / "a.log"), year=2026, tz="Europe/Berlin")
    first = entries.filter(F.col("service") == "sshd").first()
    assert first["ts_us"] == 1773568801000000 - 3_600_000_000


def test_unreadable_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.log").write_text("nothing here\n")
    with pytest.raises(ValueError):
        tables.read_logs(spark, str(tmp_path))


@pytest.mark.parametrize(
    "message,path",
    [
        ("POST /login?user=a → 401", "/login"),
        ("/first /second", "/first"),
        ("no path at all", "/unknown"),
        ("a/b /c", "/c"),
        ("/", "/"),
    ],
)
def test_request_path(spark, message, path):
    row = spark.createDataFrame([(message,)], "m string").select(L.request_path("m")).first()
    assert row[0] == path


@pytest.mark.parametrize(
    "ip,internal",
    [
        ("10.0.0.1", True), ("172.16.0.1", True), ("172.31.255.255", True), ("172.32.0.1", False),
        ("192.168.1.1", True), ("192.169.1.1", False), ("8.8.8.8", False), ("10.0.0", False),
        ("10.a.0.1", False), ("gateway", False), ("::1", False), ("10.0.0.1.5", False),
    ],
)
def test_internal_address(spark, ip, internal):
    row = spark.createDataFrame([(ip,)], "ip string").select(net.is_internal_ip("ip")).first()
    assert row[0] is internal


def test_generated_syslog_gives_the_known_alert(spark, tmp_path):
    sample = generated.sample_syslog(spark).orderBy("t").select("line")
    sample.coalesce(1).write.text(str(tmp_path / "log"))
    entries = tables.read_logs(spark, str(tmp_path / "log"), capture_id="c", year=2026)
    assert entries.count() == 165
    (row,) = rules.run_rule("ssh_brute_force", Traffic(empty(spark, PACKETS), entries)).collect()
    assert row["description"] == "SSH brute force from 10.99.88.77: 15 failed attempts in 42s"


def test_generated_access_log_parses(spark, tmp_path):
    sample = generated.sample_access_log(spark).orderBy("t").select("line")
    sample.coalesce(1).write.text(str(tmp_path / "log"))
    counts = dict(
        tables.read_logs(spark, str(tmp_path / "log")).groupBy("severity").count().collect()
    )
    assert counts == {"info": 260, "high": 15, "low": 30}


def test_generated_packets_at_reference_size(spark):
    t = Traffic(generated.sample_packets(spark))
    found = {r["rule_name"] for r in rules.run_rules(t).collect()}
    assert t.packets.count() == 485
    assert {"vertical_port_scan", "syn_scan", "malicious_port", "beaconing"} <= found
    assert not {"syn_flood", "data_exfiltration"} & found


def test_generated_packets_scale_up(spark):
    t = Traffic(generated.sample_packets(spark, scale=20))
    assert rules.run_rule("syn_flood", t).count() > 0


def test_packet_records_and_sinks(spark, tmp_path):
    lines = [
        '{"timestamp": "2026-03-15T10:00:00.5+00:00", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8",'
        ' "src_port": 1, "dst_port": 53, "protocol": "DNS", "size": 70}',
        '{"timestamp": "2026-03-15T10:00:01+00:00", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8",'
        ' "src_port": 1, "dst_port": 80, "protocol": "TCP", "size": 40, "tcp_flags": ["SYN"]}',
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    packets = tables.read_packet_records(spark, str(tmp_path / "p.json"))
    rows = packets.orderBy("seq").collect()
    assert [r["ts_us"] for r in rows] == [1773568800500000, 1773568801000000]
    assert rows[0]["tcp_flags"] == [] and rows[0]["payload_size"] == 0
    tables.save_packets(packets.withColumn("capture_id", F.lit("c")), str(tmp_path / "kept"))
    kept = tables.read_packet_table(spark, str(tmp_path / "kept"))
    assert kept.count() == 2 and kept.first()["capture_id"] == "c"
    tables.write_table(packets, str(tmp_path / "out"))
    assert (tmp_path / "out" / "capture_date=2026-03-15").is_dir()


def test_year_follows_from_the_file(spark, tmp_path):
    import os
    from datetime import datetime, timezone

    path = tmp_path / "a.log"
    path.write_text("Jan  3 08:00:00 h sshd[1]: Failed password\nDec 30 08:00:00 h sshd[1]: Failed password\nFeb 29 08:00:00 h sshd[1]: Failed password\n")
    changed = datetime(2025, 1, 3, 9, tzinfo=timezone.utc).timestamp()
    os.utime(path, (changed, changed))
    times = [r.ts_us for r in tables.read_logs(spark, str(path)).orderBy("seq").collect()]
    assert [datetime.fromtimestamp(t / 1e6, timezone.utc).strftime("%Y-%m-%d") for t in times] == ["2025-01-03", "2024-12-30", "2024-02-29"]


def test_syslog_without_a_year_is_an_error(spark):
    rows = spark.createDataFrame([("c", "f", (0, 1), "Jan  3 08:00:00 h sshd[1]: Failed password")], "capture_id string, source_file string, seq struct<block: long, line: long>, line string")
    with pytest.raises(Exception, match="carry no year"):
        parse_lines(rows).collect()
    access = rows.withColumn("line", F.lit('1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 23'))
    assert parse_lines(access).count() == 1
