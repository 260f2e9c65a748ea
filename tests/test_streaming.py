"""Streams fed file by file give what the batch operators give."""

import bisect
import random

import pandas as pd
import pytest
from made_rows import T0, log, packet
from wirelens.operators import features
from wirelens.operators.flows import build_flows
from wirelens.plans import rules
from wirelens.plans.traffic import Traffic
from wirelens.operators.anomaly import stored
from wirelens.operators.features import FEATURE_NAMES
from wirelens.schemas import LOGS, PACKETS
from wirelens.session import scratch_root
from wirelens.streaming import aggregates, scoring, sources, stateful


def land(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(str(folder))
    return sources.packet_stream(spark, str(folder), max_files=1)


def late_sentinel(at=5000.0):
    """A packet far in the future moves the watermark past everything else."""
    return packet(9999, at, src="192.0.2.250", dst="192.0.2.251", dport=9, proto="OTHER", flags=[])


def test_scans_and_bursts_across_batches(spark, tmp_path):
    rows = [packet(i, i * 1.0, dport=1 + i, flags=["SYN"]) for i in range(70)]
    dns = [packet(100 + i, i * 0.4, src="10.0.0.9", proto="DNS", dport=53, flags=[]) for i in range(120)]
    batches = [rows[:10], rows[30:] + dns[:50], rows[10:30] + dns[50:], [late_sentinel()]]
    stream = land(spark, tmp_path / "in", batches)
    batch = Traffic(spark.createDataFrame(rows + dns, PACKETS))
    scans = sources.run_available(
        stateful.scan_stream(stream, ("src_ip", "dst_ip"), "dst_port", 20), "scans"
    ).collect()
    want = rules.run_rule("vertical_port_scan", batch).collect()
    assert [(r["open_us"], r["close_us"]) for r in scans] == [(r["first_us"], r["last_us"]) for r in want]
    bursts = sources.run_available(
        stateful.burst_stream(stream.filter("protocol = 'DNS'"), "src_ip", 101), "bursts"
    ).collect()
    # No sentinel reaches this stream, so only what the watermark has passed may be given out.
    assert bursts == []


def test_burst_fires_once(spark, tmp_path):
    dns = [packet(i, i * 0.4, proto="DNS", dport=53, flags=[]) for i in range(400)]
    end = [packet(999, 4000.0, src="192.0.2.1", proto="DNS", dport=53, flags=[])]
    stream = land(spark, tmp_path / "in", [dns[:150], dns[150:], end])
    got = sources.run_available(stateful.burst_stream(stream, "src_ip", 101), "bursts").collect()
    assert [(r["source"], r["burst_n"], r["first_us"]) for r in got] == [("10.0.0.5", 151, T0)]


def test_beacons(spark, tmp_path):
    rows = [packet(i, i * 10.0) for i in range(8)]
    stream = land(spark, tmp_path / "in", [rows[:4], rows[4:], [late_sentinel()]])
    got = sources.run_available(stateful.beacon_stream(stream), "beacons").collect()
    last = max(got, key=lambda r: r["n"])
    assert (last["n"], last["mean_gap_us"], last["std_gap_us"]) == (8, 10_000_000, 0)


def test_flows_equal_batch_when_nothing_idles(spark, tmp_path):
    rows = [packet(i, i * 30.0, sport=50000 + i % 2) for i in range(10)]
    stream = land(spark, tmp_path / "in", [rows, [late_sentinel()]])
    got = sources.run_available(aggregates.flow_stream(stream), "flows")
    want = build_flows(spark.createDataFrame(rows, PACKETS)).drop("duration_seconds")
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_floods_count_sources_exactly(spark, tmp_path):
    rows = [
        packet(i, i * 0.05, src=f"198.51.100.{i % 6}", flags=["SYN"], dport=81) for i in range(101)
    ]
    relevant_end = packet(9999, 5000.0, src="192.0.2.250", flags=["SYN"], dport=81)
    stream = land(spark, tmp_path / "in", [rows[:50], rows[50:], [relevant_end]])
    (row,) = sources.run_available(aggregates.flood_stream(stream), "floods").collect()
    assert (row["rule_name"], row["packets"], row["sources"]) == ("syn_flood", 101, 6)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    stream = land(
        spark, tmp_path / "in", [[packet(0, 1000.0)], [packet(1, 1001.0)], [packet(2, 1.0)]]
    )
    root = f"{scratch_root(spark)}/late"
    query = sources.start(aggregates.flow_stream(stream), f"{root}/rows", f"{root}/check")
    query.awaitTermination()
    assert sources.late_rows(query) == 1


def test_late_rows_add_up_over_reports():
    from types import SimpleNamespace as Report

    seen = sources.LateRows()
    seen.onQueryStarted(Report(id="q"))
    for dropped in (2, 0, 5):
        operator = Report(numRowsDroppedByWatermark=dropped)
        seen.onQueryProgress(Report(progress=Report(id="q", stateOperators=[operator])))
    assert seen.dropped == {"q": 7}


class Kept:
    """A value or a list in a key's state, as the processors use it; counts what is written."""

    def __init__(self):
        self.value, self.written = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def appendList(self, rows):
        self.value = (self.value or []) + rows
        self.written += len(rows)

    def put(self, rows):
        self.value = rows
        self.written += len(rows)


class Key:
    """One key of a processor, whose timers fire as the watermark moves."""

    def __init__(self, processor, key=("c", "a", "b")):
        self.processor, self.key, self.timers, self.now, self.out = processor, key, set(), 0, []
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard
        self.getListState = self.getValueState = lambda name, schema: Kept()
        processor.init(self)

    def getCurrentWatermarkInMs(self):
        return self.now

    def take(self, *rows):
        pdf = pd.DataFrame(list(rows), columns=self.processor.columns)
        self.out += self.processor.handleInputRows(self.key, iter([pdf]), self)

    def move(self, now_us):
        self.now = now_us // 1000
        while due := [t for t in self.timers if t <= self.now]:
            self.timers.difference_update(due)
            for _ in due:
                self.out += list(self.processor.handleExpiredTimer(self.key, self, None))

    @property
    def empty(self):
        p = self.processor
        return not (p.events.exists() or p.mark.exists() or p.known.exists() or self.timers)


def test_state_goes_when_nothing_waits():
    minute = stateful.WINDOW_US
    bursts = Key(stateful.Bursts(5, minute), ("c", "s"))
    bursts.take((0,), (1,))
    bursts.move(10 * minute)
    assert bursts.out == [] and bursts.empty
    bursts = Key(stateful.Bursts(3, minute), ("c", "s"))
    bursts.take((5,), (0,), (1,))
    bursts.move(10 * minute)
    (row,) = bursts.out[0].itertuples(index=False, name=None)
    assert row == ("c", "s", 3, 0, 5) and not bursts.empty
    bursts.take((11 * minute,), (11 * minute + 1,), (11 * minute + 2,))
    bursts.move(20 * minute)
    assert len(bursts.out) == 1 and bursts.processor.events.get() is None  # fires once
    bursts.move(stateful.IDLE_US + 10 * minute)
    assert bursts.empty
    scans = Key(stateful.Scans(1, minute))
    scans.take((0, "x"), (1, "y"))
    scans.move(10 * minute)
    assert len(scans.out) == 1 and scans.empty
    beacons = Key(stateful.Beacons(5, 1.0))
    beacons.take((1,), (2,))
    beacons.move(10 * minute)
    assert beacons.processor.known.get()[0] == 2 and not beacons.empty
    beacons.move(stateful.IDLE_US + 11 * minute)
    assert beacons.empty


def test_waiting_events_are_appended_not_written_anew():
    """A hundred thousand events of one key in a thousand batches, as the watermark follows them."""
    random.seed(3)
    minute, n = stateful.WINDOW_US, 100_000
    times = sorted(random.randrange(200 * minute) for _ in range(n))
    scans = Key(stateful.Scans(0, minute))
    for first in range(0, n, 100):
        part = times[first : first + 100]
        scans.take(*[(t, "x") for t in random.sample(part, len(part))])
        scans.move(max(0, part[-1] - 2 * minute))
    scans.move(1000 * minute)
    want, at = [], 0
    while at < n:
        end = bisect.bisect_right(times, times[at] + minute)
        want.append((times[at], times[end - 1]))
        at = end
    rows = [row for pdf in scans.out for row in pdf[["open_us", "close_us"]].itertuples(index=False, name=None)]
    assert rows == want and scans.empty
    assert scans.processor.events.written < 3 * n


def test_many_waiting_events_of_one_key(spark, tmp_path):
    rows = [packet(i, us=i * 500, proto="DNS", dport=53, flags=[]) for i in range(100_000)]
    stream = land(spark, tmp_path / "in", [rows[:50_000], rows[50_000:]])
    (row,) = sources.replay(
        spark, lambda c: stateful.burst_stream(stream, "src_ip", 90_000, closing=c), "bursts"
    ).collect()
    assert (row.burst_n, row.first_us, row.last_us) == (100_000, T0, T0 + 99_999 * 500)


def test_stop_and_go_on(spark, tmp_path):
    land(spark, tmp_path / "in", [[packet(0, 1.0)]])
    stream = sources.packet_stream(spark, str(tmp_path / "in"))
    root = str(tmp_path / "run")
    first = sources.start(stream, f"{root}/rows", f"{root}/check", available_now=False)
    first.processAllAvailable()
    sources.stop_early(first)
    assert not first.isActive
    land(spark, tmp_path / "in", [[packet(1, 2.0)]])
    sources.start(stream, f"{root}/rows", f"{root}/check").awaitTermination()
    assert spark.read.parquet(f"{root}/rows").count() == 2


def test_log_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    got = sources.run_available(sources.log_line_stream(spark, str(tmp_path / "in")), "lines")
    assert sorted(r["line"] for r in got.collect()) == ["one", "two"]


def land_logs(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, LOGS).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_replay_gives_out_what_is_still_open(spark, tmp_path):
    rows = [packet(i, i * 1.0, dport=1 + i, flags=["SYN"]) for i in range(70)]
    dns = [packet(100 + i, i * 0.4, src="10.0.0.9", proto="DNS", dport=53, flags=[]) for i in range(120)]
    stream = land(spark, tmp_path / "in", [rows[:10] + dns[:50], rows[10:] + dns[50:]])
    (burst,) = sources.replay(
        spark, lambda c: stateful.burst_stream(stream.filter("protocol = 'DNS'"), "src_ip", 101, closing=c), "bursts"
    ).collect()
    assert (burst["source"], burst["burst_n"], burst["first_us"]) == ("10.0.0.9", 120, T0)
    scans = sources.replay(
        spark, lambda c: stateful.scan_stream(stream, ("src_ip", "dst_ip"), "dst_port", 20, closing=c), "scans"
    ).collect()
    want = rules.run_rule("vertical_port_scan", Traffic(spark.createDataFrame(rows + dns, PACKETS))).collect()
    assert [(r["open_us"], r["close_us"]) for r in scans] == [(r["first_us"], r["last_us"]) for r in want]
    flows = sources.replay(spark, lambda c: aggregates.flow_stream(stream, closing=c), "flows")
    assert flows.count() == len({(r[3], r[4], r[5], r[6]) for r in rows + dns})
    assert flows.filter("capture_id is null").count() == 0


def test_features_join_packets_and_entries(spark, tmp_path):
    packets = [[packet(i, i * 7.0, size=60 + i) for i in range(20)], [packet(50, 400.0), packet(51, 401.0)]]
    entries = [[log(i, i * 10.0) for i in range(30)], [log(40, 600.0), log(41, 401.0, severity="info")]]
    stream, logs = land(spark, tmp_path / "p", packets), land_logs(spark, tmp_path / "l", entries)
    got = sources.replay(spark, lambda c: aggregates.feature_stream(stream, logs=logs, closing=c), "features")
    rows = {(r.window_start.timestamp() * 1e6 - T0) / 60e6: r for r in got.withColumn("window_start", got.window_start).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 6, 10]
    assert [rows[k].http_error_count for k in (0, 1, 2, 6)] == [6, 6, 6, 0]
    assert all(rows[10][c] == rows[3][c] == 0 for c in FEATURE_NAMES)  # no packets: all zero, as in batch
    flat = [r for part in packets for r in part]
    batch = features.window_features(
        Traffic(spark.createDataFrame(flat, PACKETS), spark.createDataFrame(sum(entries, []), LOGS))
    ).collect()
    for row in batch:  # T0 is a whole minute, so both count from the same place
        if row.packets_per_second:
            assert [row[c] for c in FEATURE_NAMES] == pytest.approx([rows[row.w][c] for c in FEATURE_NAMES])


def some_windows(spark, n=400, seed=1, capture="c"):
    random.seed(seed)
    rows = [
        (capture, i, T0 + i * 60_000_000, *[random.gauss(10, 2) * (9 if i % 97 == 5 else 1) for _ in FEATURE_NAMES])
        for i in range(n)
    ]
    columns = ", ".join(f"{c} double" for c in FEATURE_NAMES)
    return spark.createDataFrame(rows, f"capture_id string, w bigint, window_start_us bigint, {columns}")


def test_stored_models_have_versions(spark, tmp_path):
    path = str(tmp_path / "models")
    windows = some_windows(spark)
    assert stored.publish(stored.train(windows), path) == 1
    assert stored.publish(stored.train(windows.filter("w < 200"), by_capture=True), path) == 2
    assert {(r.version, r.by_capture, r.models, r.windows) for r in stored.versions(spark, path).collect()} == {
        (1, False, 1, 400), (2, True, 1, 200)
    }
    assert stored.load(spark, path).version == 2
    with pytest.raises(ValueError):
        stored.load(spark, path, 7)
    one = stored.load(spark, path, 1)
    found = {r.window_start_us: r for r in stored.score(windows, one).collect()}
    odd = [r for t, r in found.items() if (t - T0) // 60_000_000 % 97 == 5]
    assert all(r.isolation_forest == -1 for r in odd) and sum(r.isolation_forest == -1 for r in found.values()) <= 21
    assert {r.version for r in found.values()} == {1}
    # A window's score is its own: the same alone and among others, and by an unknown capture too.
    few = stored.score(some_windows(spark, capture="new").filter("w < 3"), one).collect()
    assert len(few) == 3
    for r in few:
        same = found[r.window_start_us]
        assert (r.forest_score, r.svm_score) == pytest.approx((same.forest_score, same.svm_score), rel=1e-12)
    unknown = stored.score(some_windows(spark, 5, capture="new"), stored.load(spark, path, 2)).collect()
    assert len(unknown) == 5 and all(r.forest_score is None and r.isolation_forest is None for r in unknown)


def test_a_stream_scores_as_batch_also_after_a_restart(spark, tmp_path):
    models = stored.train(some_windows(spark))
    rows = [packet(i, i * 2.0, dport=i % 50, size=60 + i % 900) for i in range(400)]
    land(spark, tmp_path / "in", [rows[:200]])
    stream = sources.packet_stream(spark, str(tmp_path / "in"), max_files=1)
    features_of = aggregates.feature_stream(stream)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    scoring.start_scoring(features_of, models, out, check).awaitTermination()
    first = scoring.read_scores(spark, out).count()
    land(spark, tmp_path / "in", [rows[200:], [late_sentinel()]])
    scoring.start_scoring(features_of, models, out, check).awaitTermination()
    got = sorted(map(tuple, scoring.read_scores(spark, out).collect()))
    assert 0 < first < len(got) == 14
    batch = features.window_features(Traffic(spark.createDataFrame(rows, PACKETS)))
    want = sorted(map(tuple, stored.score(batch, models).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for one, other in zip(got, want):
        assert one[2:7] == pytest.approx(other[2:7])


def test_a_batch_that_runs_again_leaves_its_windows_once(spark, tmp_path):
    models = stored.train(some_windows(spark))
    batch = some_windows(spark, 30).selectExpr("*", "timestamp_micros(window_start_us) as window_start").drop("window_start_us")
    write = scoring.score_batches(models, str(tmp_path / "out"))
    for epoch in (0, 1, 1, 0):
        write(batch.filter(f"w % 2 = {epoch}"), epoch)
    rows = scoring.read_scores(spark, str(tmp_path / "out")).collect()
    assert len(rows) == len({r.window_start_us for r in rows}) == 30


def test_a_batch_is_computed_once(spark, tmp_path):
    models = stored.train(some_windows(spark))
    batch = some_windows(spark, 30).selectExpr("*", "timestamp_micros(window_start_us) as window_start").drop("window_start_us")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    scoring.score_batches(models, str(tmp_path / "out"))(batch.mapInPandas(count, batch.schema), 0)
    assert seen.value == 30 and scoring.read_scores(spark, str(tmp_path / "out")).count() == 30
