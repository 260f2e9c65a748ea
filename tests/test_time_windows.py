"""Window primitives against plain sequential walks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from wirelens.operators import time_windows
from wirelens.operators.time_windows import first_burst, gap_statistics, greedy_windows, slot

MIN = 60_000_000


def random_events(seed, n=400, keys=3, span_s=1200, items=30):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        t = rng.choice([rng.randrange(span_s) * 1_000_000, rng.randrange(span_s * 1_000_000)])
        rows.append((f"k{rng.randrange(keys)}", t, rng.randrange(items)))
    return rows


def walk(rows, more_than):
    found = set()
    for key in {r[0] for r in rows}:
        events = sorted((t, i) for k, t, i in rows if k == key)
        at = 0
        while at < len(events):
            window = [e for e in events[at:] if e[0] - events[at][0] <= MIN]
            items = {i for _, i in window}
            if len(items) > more_than:
                found.add((key, window[0][0], window[-1][0], len(items)))
            at += len(window)
    return found


@pytest.mark.parametrize("seed,fold_rows", [(1, 10**6), (1, 0), (2, 40), (3, 0)])
def test_greedy_windows(spark, seed, fold_rows):
    rows = random_events(seed)
    events = spark.createDataFrame(rows, "k string, ts_us bigint, item int")
    items = events.groupBy("k", slot(MIN).alias("slot"), "item").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )
    got = (
        greedy_windows(events, items, ["k"], 8, MIN, fold_rows)
        .groupBy("k", "open_us", "close_us")
        .count()
        .filter("count > 8")
    )
    assert {tuple(r) for r in got.collect()} == walk(rows, 8)


def test_long_runs_follow_fewer_times_each_round(spark, monkeypatch):
    """Sixty slots take six rounds; hops that meet go on as one, so all rounds hold few rows in all."""
    rng = random.Random(5)
    rows = [("k", rng.randrange(60 * MIN), rng.randrange(30)) for _ in range(6_000)]
    events = spark.createDataFrame(rows, "k string, ts_us bigint, item int")
    items = events.groupBy("k", slot(MIN).alias("slot"), "item").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )
    write, hops = time_windows.scratch_table, []

    def counted(df, name):
        table = write(df, name)
        if name == "run-hops":
            hops.append(table.count())
        return table

    monkeypatch.setattr(time_windows, "scratch_table", counted)
    got = greedy_windows(events, items, ["k"], 8, MIN, fold_rows=0).groupBy("k", "open_us", "close_us").count()
    assert {tuple(r) for r in got.collect()} == walk(rows, 8)
    assert len(hops) == 6 and sum(hops) < 2.5 * len(rows)


def test_greedy_window_is_inclusive_at_sixty_seconds(spark):
    for last, windows in ((MIN, 1), (MIN + 1, 2)):
        rows = [("k", 0, 1), ("k", 30_000_000, 2), ("k", last, 3)]
        events = spark.createDataFrame(rows, "k string, ts_us bigint, item int")
        items = events.groupBy("k", slot(MIN).alias("slot"), "item").agg(
            F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
        )
        got = greedy_windows(events, items, ["k"], 0, MIN)
        assert got.select("open_us").distinct().count() == windows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("threshold", [10, 18, 30])
def test_first_burst(spark, seed, threshold):
    rows = random_events(seed, n=300, span_s=900)
    expected = set()
    for key in {r[0] for r in rows}:
        times = sorted(t for k, t, _ in rows if k == key)
        for i, t in enumerate(times):
            inside = [u for u in times[i:] if u <= t + MIN]
            if len(inside) >= threshold:
                expected.add((key, len(inside), inside[0], inside[-1]))
                break
    events = spark.createDataFrame(rows, "k string, ts_us bigint, item int").select("k", "ts_us")
    got = first_burst(events, ["k"], threshold, MIN)
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_gap_statistics_with_ties(spark, seed):
    rows = random_events(seed, n=200)
    got = {
        r["k"]: r
        for r in gap_statistics(
            spark.createDataFrame(rows, "k string, ts_us bigint, item int"), ["k"]
        ).collect()
    }
    for key in {r[0] for r in rows}:
        times = sorted(t for k, t, _ in rows if k == key)
        gaps = [b - a for a, b in zip(times, times[1:])]
        assert got[key]["n"] == len(times)
        assert got[key]["mean_gap_us"] == pytest.approx(statistics.mean(gaps), rel=1e-9)
        assert got[key]["std_gap_us"] == pytest.approx(statistics.stdev(gaps), rel=1e-9)


def test_gap_statistics_of_short_keys(spark):
    rows = [("one", 5), ("two", 5), ("two", 9)]
    got = {r["k"]: r for r in gap_statistics(spark.createDataFrame(rows, "k string, ts_us bigint"), ["k"]).collect()}
    assert got["one"]["mean_gap_us"] is None and got["one"]["std_gap_us"] is None
    assert got["two"]["mean_gap_us"] == 4 and got["two"]["std_gap_us"] is None


@pytest.mark.parametrize("last,hit", [(MIN, True), (MIN + 1, False)])
def test_first_burst_is_inclusive_at_sixty_seconds(spark, last, hit):
    times = [0, 0, 30_000_000, last, 5 * MIN]
    events = spark.createDataFrame([("k", t) for t in times], "k string, ts_us bigint")
    got = [tuple(r) for r in first_burst(events, ["k"], 4, MIN).collect()]
    assert got == ([("k", 4, 0, last)] if hit else [])


def test_first_burst_of_ties_counts_them_all(spark):
    events = spark.createDataFrame([("k", 7)] * 50 + [("k", 9)] * 3 + [("k", 1)], "k string, ts_us bigint")
    assert [tuple(r) for r in first_burst(events, ["k"], 5, MIN).collect()] == [("k", 54, 1, 9)]


def test_first_burst_of_many_events_in_one_window(spark):
    """Half a million events of one source in a minute; a frame over all of them would take hours."""
    events = spark.range(500_000).selectExpr("'k' as k", "id * 100 as ts_us")
    (row,) = first_burst(events, ["k"], 101, MIN).collect()
    assert tuple(row) == ("k", 500_000, 0, 49_999_900)


def test_long_runs_take_a_round_for_each_doubling_of_blocks(spark, monkeypatch):
    """Sixty slots of some 100 events in seven blocks: three rounds, over the entries of blocks alone."""
    rng = random.Random(6)
    rows = [("k", rng.randrange(60 * MIN), rng.randrange(30)) for _ in range(6_000)]
    rows += [("l", rng.randrange(3 * MIN), rng.randrange(30)) for _ in range(300)]
    events = spark.createDataFrame(rows, "k string, ts_us bigint, item int")
    items = events.groupBy("k", slot(MIN).alias("slot"), "item").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )
    write, hops = time_windows.scratch_table, []

    def counted(df, name):
        table = write(df, name)
        if name == "run-hops":
            hops.append(table.count())
        return table

    monkeypatch.setattr(time_windows, "scratch_table", counted)
    got = greedy_windows(events, items, ["k"], 8, MIN, fold_rows=900).groupBy("k", "open_us", "close_us").count()
    assert {tuple(r) for r in got.collect() if r[3] > 8} == walk(rows, 8)
    assert len(hops) == 3 and sum(hops) < len(rows) / 4


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_walks_pass_sparse_and_dense_blocks(spark, seed):
    """Blocks of one slot, slots with one event and events a window apart, whatever the size of a block."""
    rng = random.Random(seed)
    times = [
        rng.choice([0, 0, 1, MIN - 1, rng.randrange(MIN)]) + MIN * s
        for s in range(30)
        for _ in range(rng.choice([1, 1, 2, 9]))
    ]
    rows = [("k", t, rng.randrange(9)) for t in times]
    events = spark.createDataFrame(rows, "k string, ts_us bigint, item int")
    items = events.groupBy("k", slot(MIN).alias("slot"), "item").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )
    for fold_rows in (0, 3, 12):
        got = greedy_windows(events, items, ["k"], 0, MIN, fold_rows).groupBy("k", "open_us", "close_us").count()
        assert {tuple(r) for r in got.collect()} == walk(rows, 0)


@pytest.mark.parametrize("fold_rows", [0, 10**6])
def test_events_without_time_or_key_open_no_window(spark, fold_rows):
    rows = [(80, 1, 1), (80, MIN + 5, 2), (80, None, 3), (80, None, 4), (None, 7, 1), (None, 8, 2), (None, None, 3)]
    events = spark.createDataFrame(rows, "port int, ts_us bigint, item int")
    items = events.groupBy("port", slot(MIN).alias("slot"), "item").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )
    got = greedy_windows(events, items, ["port"], 0, MIN, fold_rows)
    assert sorted(map(tuple, got.collect())) == [(80, 1, 1, 1), (80, MIN + 5, MIN + 5, 2)]
