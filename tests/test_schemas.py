"""Record checks in place of enumerated types; defaults; text forms."""

import pytest
from pyspark.sql import functions as F

from made_rows import T0, log, packet
from wirelens.functions import net, text
from wirelens.schemas import (
    LOGS,
    PACKETS,
    alert_problem,
    log_problem,
    packet_problem,
    threat_problem,
    validate,
    with_packet_defaults,
)


def test_packet_defaults(spark):
    row = list(packet())
    row[-1] = row[-2] = None
    got = with_packet_defaults(spark.createDataFrame([tuple(row)], PACKETS)).first()
    assert got["tcp_flags"] == [] and got["payload_size"] == 0


def test_packets_are_split(spark):
    bad = list(packet(1))
    bad[3] = None
    good, rejected = validate(
        spark.createDataFrame([packet(0), tuple(bad)], PACKETS), packet_problem()
    )
    assert good.count() == 1 and rejected.first()["problem"] == "src_ip missing"


def test_log_severity(spark):
    good, rejected = validate(
        spark.createDataFrame([log(), log(severity="fatal")], LOGS), log_problem()
    )
    assert good.count() == 1 and rejected.first()["problem"] == "severity unknown"


def test_alert_and_threat_bounds(spark):
    alerts = spark.createDataFrame([("r", "high"), ("r", "info")], "rule_name string, severity string")
    assert validate(alerts, alert_problem())[1].count() == 1
    threats = spark.createDataFrame(
        [("PORT_SCAN", 100, "high", "rule"), ("PORT_SCAN", 101, "high", "rule"),
         ("OTHER", 1, "high", "ml"), ("PORT_SCAN", 1, "high", "guess")],
        "category string, severity_score int, severity_label string, detection_method string",
    )
    good, rejected = validate(threats, threat_problem())
    assert good.count() == 1 and rejected.count() == 3


@pytest.mark.parametrize(
    "value,digits,expected",
    [(2.675, 2, "2.67"), (0.25, 1, "0.2"), (0.5, 0, "0"), (1.5, 0, "2"), (2.5, 0, "2"), (1234.56, 1, "1234.6")],
)
def test_numbers_round_half_even_on_the_binary_value(spark, value, digits, expected):
    assert spark.range(1).select(text.fixed(F.lit(value), digits)).first()[0] == expected
    assert f"{value:.{digits}f}" == expected


def test_iso_times(spark):
    got = spark.createDataFrame([(T0,), (T0 + 5,)], "t bigint").select(text.iso_time("t"), "t")
    assert [r[0] for r in got.collect()] == [
        "2026-03-15T10:00:00+00:00", "2026-03-15T10:00:00.000005+00:00",
    ]
    back = got.toDF("iso", "t").select(text.iso_to_us("iso"), "t").collect()
    assert all(a == b for a, b in back)


def test_packet_filter(spark):
    df = spark.createDataFrame(
        [packet(0), packet(1, 5.0, src="10.0.0.6", dport=22), packet(2, 9.0, proto="UDP")], PACKETS
    )

    def seqs(**kw):
        return [r["seq"] for r in df.filter(net.packet_filter(**kw)).orderBy("seq").collect()]

    assert seqs() == [0, 1, 2]
    assert seqs(protocols=["UDP"]) == [2]
    assert seqs(host="203.0.113.9", port=22) == [1]
    assert seqs(src="10.0.0.5", until_us=T0 + 1) == [0]
    assert seqs(dst="203.0.113.9", dst_port=80, since_us=T0 + 1) == [2]


def test_flag_letters(spark):
    df = spark.createDataFrame([("SA",), ("",), ("FPUEC",)], "l string")
    got = [r[0] for r in df.select(net.flag_names("l")).collect()]
    assert got == [["SYN", "ACK"], [], ["FIN", "PSH", "URG"]]
