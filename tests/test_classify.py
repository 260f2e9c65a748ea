"""Threats: conversion, merging in order (against a plain re-telling of the rule), reports."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from made_rows import T0, packet
from wirelens.operators import classify, reports
from wirelens.schemas import ALERTS, MEMBERS

RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def alert(i, first, last, severity="high", source="10.0.0.1", category="PORT_SCAN", dest="9.9.9.9",
          evidence=None):
    return ("c", f"a{i:04d}", "rule", 0, severity, category, f"text {i}", source, 1, source, dest, 1,
            T0 + first, T0 + last, json.dumps(evidence or {"id": i}))


def members_of(spark, rows):
    members = []
    for r in rows:
        members += [("c", r[1], "source_ip", r[7]), ("c", r[1], "dest_ip", r[10])]
    return spark.createDataFrame(members, MEMBERS)


def run(spark, rows, anomalies=None, **kw):
    alerts = spark.createDataFrame(rows, ALERTS)
    return classify.classify(alerts, members_of(spark, rows), anomalies, **kw)


def test_lone_alerts_are_not_walked(monkeypatch):
    """Of islands inside a batch only those with several alerts; one that goes on in the next batch is whole."""
    names = [f"i{i:03d}" for i in range(50)] + ["i050"] * 3
    rows = pd.DataFrame({
        "capture_id": "c", "alert_id": [f"a{i}" for i in range(53)], "island": names, "ord_key": "0",
        "first_us": 0, "last_us": 5, "severity_score": 60, "method": 0,
    })
    walk, walked = classify._assign_island, []
    monkeypatch.setattr(classify, "_assign_island", lambda island: walked.append(len(island)) or walk(island))
    got = pd.concat(classify._assign(iter([rows[:30], rows[30:30], rows[30:51], rows[51:]])))
    assert sorted(walked) == [1, 1, 1, 3]
    assert sorted(got["alert_id"]) == sorted(rows["alert_id"]) and got["leads"].sum() == 51
    assert (got["threat_no"] == 0).all() and (got["epoch"] == 0).all() and not got["joins_methods"].any()


@pytest.mark.parametrize("seed", range(3))
def test_merging_follows_the_order(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        start = rng.randrange(400)
        rows.append(alert(i, start, start + rng.randrange(60), rng.choice(list(RANK)[:3]),
                          rng.choice(["10.0.0.1", "10.0.0.2"])))
    expected = {}
    for source in ("10.0.0.1", "10.0.0.2"):
        waiting = sorted((r for r in rows if r[7] == source), key=lambda r: (RANK[r[4]], r[1]))
        while waiting:
            head = waiting.pop(0)
            taken = [r for r in waiting if r[12] <= head[13] and head[12] <= r[13]]
            waiting = [r for r in waiting if r not in taken]
            expected[head[1]] = 1 + len(taken)
    got = run(spark, rows).threats.collect()
    assert {r["threat_id"]: r["n_alerts"] for r in got} == expected


def test_touching_ranges_merge_and_gaps_do_not(spark):
    rows = [alert(1, 0, 10), alert(2, 10, 20, dest="8.8.8.8"), alert(3, 21, 30)]
    t = run(spark, rows)
    assert {r["threat_id"]: r["n_alerts"] for r in t.threats.collect()} == {"a0001": 2, "a0003": 1}
    dests = t.members.filter("threat_id = 'a0001' and role = 'dest_ip'").collect()
    assert {r["value"] for r in dests} == {"9.9.9.9", "8.8.8.8"}


def test_evidence_of_the_leader_wins(spark):
    rows = [
        alert(1, 0, 10, "high", evidence={"x": 1, "only_first": "a"}),
        alert(2, 0, 10, "critical", evidence={"x": 2}),
    ]
    got = {r["key"]: r["value"] for r in run(spark, rows).evidence.collect()}
    assert got == {"x": "2", "only_first": "a"}


def anomaly_rows(spark, scores):
    rows = [
        ("c", w, T0 + w * 60_000_000, T0 + (w + 1) * 60_000_000, s, ["f (1.0x above baseline)"],
         (-1, -1, 1))
        for w, s in scores
    ]
    return spark.createDataFrame(
        rows,
        "capture_id string, w bigint, start_us bigint, end_us bigint, anomaly_score double, "
        "contributing array<string>, votes struct<isolation_forest:int,local_outlier_factor:int,"
        "one_class_svm:int>",
    )


def test_higher_anomaly_takes_over_a_run_of_windows(spark):
    # 0 absorbs nothing higher until 1 takes over; 2 touches 1; 3 no longer touches 0 but touches 2,
    # which is merged, so it starts its own threat.
    found = run(spark, [alert(1, 0, 10)], anomaly_rows(spark, [(0, 0.5), (1, 0.9), (2, 0.6), (3, 0.7)]))
    got = {
        r["threat_id"]: (r["n_alerts"], r["severity_score"], r["severity_label"], r["detection_method"])
        for r in found.threats.filter("category = 'ANOMALOUS_TRAFFIC'").collect()
    }
    assert got == {
        "anomaly|000000000001": (3, 72, "high", "ml"),
        "anomaly|000000000003": (1, 56, "medium", "ml"),
    }


def test_rule_and_anomaly_of_one_category_become_both(spark):
    rows = [alert(1, 0, 10, "medium", category="ANOMALOUS_TRAFFIC")]
    rows = [r[:7] + (None, 0, "0", None, 0) + r[12:] for r in rows]
    alerts = spark.createDataFrame(rows, ALERTS)
    found = classify.classify(
        alerts, spark.createDataFrame([], MEMBERS), anomaly_rows(spark, [(0, 0.5)])
    )
    (row,) = found.threats.collect()
    assert (row["detection_method"], row["severity_score"]) == ("both", 55)


def test_whole_islands(spark):
    rows = [alert(1, 0, 10), alert(2, 5, 20), alert(3, 15, 30, "critical"), alert(4, 40, 50)]
    got = run(spark, rows, merge="whole_islands").threats.collect()
    assert {r["threat_id"]: r["n_alerts"] for r in got} == {"a0003": 3, "a0004": 1}


def test_titles_scores_and_order(spark):
    rows = [
        alert(1, 0, 1, "medium"),
        alert(2, 0, 1, "critical", category="DDOS_ATTACK"),
        alert(3, 0, 1, "low", category="BRUTE_FORCE"),
        alert(4, 0, 1, "high", category="SUSPICIOUS_CONNECTION"),
        alert(5, 0, 1, "high", category="DNS_TUNNELING"),
    ]
    got = classify.ordered(run(spark, rows).threats).collect()
    assert [r["severity_score"] for r in got] == [80, 60, 60, 40, 20]
    assert [r["title"] for r in got] == [
        "DDoS Attack targeting 9.9.9.9",
        "Suspicious Connection to 9.9.9.9",
        "DNS Tunneling from 10.0.0.1",
        "Vertical Port Scan from 10.0.0.1",
        "Brute Force from 10.0.0.1",
    ]


def test_reports_without_threats(spark, traffic):
    from wirelens.operators.summaries import capture_summary

    none = run(spark, [alert(1, 0, 1)]).threats.filter("false")
    facts = reports.executive_facts(none, capture_summary(traffic([packet()]))).first()
    assert facts["total_threats"] == 0 and facts["top_category"] == "N/A"


def test_every_category_has_recommendations(spark):
    cats = spark.createDataFrame([(c,) for c in classify.RECOMMENDATIONS], "category string")
    assert all(len(r[0]) == 3 for r in cats.select(classify.recommendations("category")).collect())
    other = spark.createDataFrame([("OTHER",)], "category string")
    assert other.select(classify.recommendations(F.col("category"))).first()[0] == []


def plain_walk(rows):
    """Threats one by one; each row (first, last, score, method) goes to the first that it overlaps."""
    threats, out = [], []
    for first, last, score, method in rows:
        no = next((i for i, t in enumerate(threats) if t[0] <= last and t[1] >= first), None)
        leads = joins = False
        if no is None:
            no, leads = len(threats), True
            threats.append([first, last, score, method, 0])
        elif score > threats[no][2]:
            threats[no][:4] = first, last, score, method
            threats[no][4] += 1
            leads = True
        elif {threats[no][3], method} == {0, 1}:
            threats[no][3], joins = 2, True
            threats[no][2] = min(threats[no][2] + 15, 100)
        out.append((no, threats[no][4], leads, joins))
    return out


def island_of(rows):
    frame = pd.DataFrame(rows, columns=["first_us", "last_us", "severity_score", "method"])
    return frame.assign(capture_id="c", island="i", alert_id=[str(i) for i in range(len(rows))])


@pytest.mark.parametrize("seed", range(8))
def test_ranges_are_found_as_by_a_plain_walk(seed):
    rng = random.Random(seed)
    span = rng.choice([20, 300, 100_000])
    rows = []
    for _ in range(600):
        first = rng.randrange(span)
        last = first + rng.randrange(rng.choice([1, 5, span // 4]) + 1)
        rows.append((first, last, rng.choice([30, 50, 50, 70, 90]), rng.choice([0, 0, 0, 1])))
    rows[17] = (0, -1, 50, 0)  # without times
    got = classify._assign_island(island_of(rows))
    assert list(got[["threat_no", "epoch", "leads", "joins_methods"]].itertuples(index=False, name=None)) == plain_walk(rows)


def test_islands_may_span_batches():
    rng = random.Random(2)
    frames = []
    for name in "abc":
        rows = [(t, t + rng.randrange(9), rng.choice([30, 50]), 0) for t in (rng.randrange(90) for _ in range(50))]
        frames.append(island_of(rows).assign(island=name))
    every = pd.concat(frames, ignore_index=True)
    whole = pd.concat(classify._assign(iter([every])), ignore_index=True)
    parts = pd.concat(classify._assign(iter([every[i : i + 7] for i in range(0, 150, 7)])), ignore_index=True)
    assert whole.equals(parts) and len(whole) == 150


def test_a_large_island_takes_n_log_n_steps():
    n = 200_000
    rows = [(i * 10, i * 10 + 5, 50, 0) for i in range(n)] + [(0, 10 * n, 40, 0)]
    started = time.perf_counter()
    got = classify._assign_island(island_of(rows))
    assert got["threat_no"].tolist() == [*range(n), 0]
    assert time.perf_counter() - started < 60  # a linear scan per row takes minutes
