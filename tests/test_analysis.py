"""The whole analysis, and intermediate tables in the shared folder."""

from pathlib import Path

from made_rows import log, packet
from wirelens.operators import reports
from wirelens.plans.analysis import analyse
from wirelens.session import scratch_folder, scratch_root, scratch_table


def test_analysis_of_two_captures(traffic):
    rows = []
    for c in ("c", "d"):
        rows += [packet(i, i * 1.0, dport=1 + i, flags=["SYN"], capture_id=c) for i in range(30)]
        rows += [packet(100 + i, i * 60.0, sport=1000 + i, capture_id=c, src="10.0.0.8") for i in range(8)]
    logs = [log(i, i * 2.0) for i in range(6)]
    found = analyse(traffic(rows, logs))
    threats = found.threats.threats.collect()
    per_capture = {c: {t["title"] for t in threats if t["capture_id"] == c} for c in ("c", "d")}
    assert per_capture["c"] - per_capture["d"] == {"Brute Force from 198.51.100.7"}
    # The scan merges with the SYN scan of the same source, which overlaps it.
    scans = [t for t in threats if t["category"] == "PORT_SCAN" and t["source_ip"] == "10.0.0.5"]
    assert [t["n_alerts"] for t in scans] == [2, 2]
    facts = {f["capture_id"]: f for f in found.facts.collect()}
    assert facts["c"]["packet_count"] == 38
    table = reports.threat_table(found.threats.threats, found.threats.members)
    assert table.count() == len(threats)


def test_scratch_tables_live_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_root(spark) == root
    assert scratch_table(spark.range(5), "five").count() == 5
    local = Path(scratch_folder(spark).removeprefix("file:"))
    assert any(p.name.startswith("five-") for p in local.iterdir())
