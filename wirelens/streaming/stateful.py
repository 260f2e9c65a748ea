"""Streaming forms that need ordered state per key: bursts, greedy scans, beaconing.

Events wait in the state of their key until the watermark says that nothing earlier can come; then they are
taken in order. New events are appended to a list in the state store (RocksDB, see `session`), which is read when
a timer of the key fires, not at every batch. What is settled is marked by a time; the list is written anew only
when more than half of it is settled, so each event is written about twice. What waits is bounded by the window
plus the allowed lateness.

The state of a key goes when nothing waits; what is remembered longer (that a source has fired, the gaps of a
pair) goes after `IDLE_US` of event time without events, and the key then starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wirelens.streaming.sources import LATENESS, timed

WINDOW_US = 60_000_000
IDLE_US = 24 * 3600 * 1_000_000


class Waiting(StatefulProcessor):
    """Events of a key that wait, and the key's one timer.

    `columns` are those of the events that are kept, `ts_us` first. `due(times)` says by when the first of the
    waiting events is to be looked at; `settle` takes what is settled.
    """

    columns, types = ("ts_us",), "ts_us bigint"
    memory = "done boolean"  # what a key remembers besides

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.types)
        self.mark = handle.getValueState("mark", "since bigint, timer bigint")
        self.known = handle.getValueState("known", self.memory)

    def close(self) -> None:
        pass

    def arm(self, since: int, due_us: int, now_ms: int) -> None:
        """Events before `since` are settled; wake up when the watermark passes `due_us`, if that is sooner."""
        timer = max(due_us // 1000 + 1, now_ms + 1)
        old = self.mark.get()[1] if self.mark.exists() else None
        if old is not None and old <= now_ms:
            old = None  # has fired
        if old is not None and old <= timer:
            timer = old
        else:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.mark.update((since, timer))

    def forget(self) -> None:
        for state in (self.events, self.mark, self.known):
            state.clear()

    def rest(self) -> None:
        """Nothing waits; what is known stays until the key has been idle."""
        self.events.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now_ms = int(timerValues.getCurrentWatermarkInMs())
        since = self.mark.get()[0] if self.mark.exists() else -(1 << 62)
        first = last = None
        for pdf in rows:
            if not len(pdf):
                continue
            low, high = int(pdf["ts_us"].min()), int(pdf["ts_us"].max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
            if not self.ended():
                self.events.appendList(list(pdf[list(self.columns)].itertuples(index=False, name=None)))
        if first is not None:
            if self.ended():
                self.mark.update((since, self.mark.get()[1]))
            else:
                self.arm(min(since, first) if since > first else since, first + self.wait_us, now_ms)
        return iter(())

    def ended(self) -> bool:
        """Whether the key takes no more events."""
        return False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = int(timerValues.getCurrentWatermarkInMs())
        since = self.mark.get()[0] if self.mark.exists() else -(1 << 62)
        every = list(self.events.get()) if self.events.exists() else []
        waiting = sorted((e for e in every if e[0] >= since), key=lambda e: e[0])
        if not waiting:
            self.forget()
            return
        found, left, until = self.settle(key, waiting, now_ms * 1000)
        if found is not None:
            yield found
        if not left:
            self.rest()
            if self.known.exists():
                self.mark.update((until, None))
                self.arm(until, waiting[-1][0] + IDLE_US, now_ms)
            else:
                self.forget()
            return
        if 2 * len(left) < len(every):
            self.events.put(left)
        self.mark.update((until, None))
        self.arm(until, left[0][0] + self.wait_us, now_ms)


class Bursts(Waiting):
    """The first burst of a source; a source that has fired keeps one flag."""

    def __init__(self, threshold: int, window_us: int):
        self.threshold, self.wait_us = threshold, window_us

    def ended(self) -> bool:
        return self.known.exists()

    def settle(self, key, waiting: list[tuple], settled_us: int):
        times = np.array([t for (t,) in waiting], np.int64)
        ahead = np.searchsorted(times, times + self.wait_us, side="right")
        decided = times + self.wait_us < settled_us
        hits = np.flatnonzero(decided & (ahead - np.arange(len(times)) >= self.threshold))
        if hits.size:
            i = int(hits[0])
            self.known.update((True,))
            row = (*key, int(ahead[i] - i), int(times[i]), int(times[ahead[i] - 1]))
            columns = ["capture_id", "source", "burst_n", "first_us", "last_us"]
            return pd.DataFrame([row], columns=columns), [], settled_us
        left = [(int(t),) for t in times[~decided]]
        return None, left, left[0][0] if left else settled_us


def _keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def burst_stream(
    events: DataFrame,
    source: str,
    threshold: int,
    window_us: int = WINDOW_US,
    lateness: str = LATENESS,
    closing: DataFrame | None = None,
) -> DataFrame:
    """First burst per source, as `first_burst` in batch."""
    rows = timed(events.select("capture_id", F.col(source).alias("source"), "ts_us"), lateness, closing)
    return _keyed(
        rows,
        ["capture_id", "source"],
        Bursts(threshold, window_us),
        "capture_id string, source string, burst_n bigint, first_us bigint, last_us bigint",
    )


class Scans(Waiting):
    """Greedy windows: each opens at the first event that no earlier one holds."""

    columns, types = ("ts_us", "item"), "ts_us bigint, item string"

    def __init__(self, more_than: int, window_us: int):
        self.more_than, self.wait_us = more_than, window_us

    def settle(self, key, waiting: list[tuple], settled_us: int):
        times = np.array([t for t, _ in waiting], np.int64)
        at, found = 0, []
        while at < len(times) and times[at] + self.wait_us < settled_us:
            end = int(np.searchsorted(times, times[at] + self.wait_us, side="right"))
            distinct = len({item for _, item in waiting[at:end]})
            if distinct > self.more_than:
                found.append((*key, distinct, int(times[at]), int(times[end - 1])))
            at = end
        columns = ["capture_id", "a", "b", "items", "open_us", "close_us"]
        left = waiting[at:]
        return (
            pd.DataFrame(found, columns=columns) if found else None,
            left,
            left[0][0] if left else settled_us,
        )


def scan_stream(
    packets: DataFrame,
    keys: tuple[str, str],
    item: str,
    more_than: int,
    window_us: int = WINDOW_US,
    lateness: str = LATENESS,
    closing: DataFrame | None = None,
) -> DataFrame:
    """Greedy windows with more than `more_than` distinct items, as the scan rules in batch."""
    a, b = keys
    rows = timed(
        packets.select(
            "capture_id",
            F.col(a).cast("string").alias("a"),
            F.col(b).cast("string").alias("b"),
            F.col(item).cast("string").alias("item"),
            "ts_us",
        ),
        lateness,
        closing,
    )
    found = _keyed(
        rows,
        ["capture_id", "a", "b"],
        Scans(more_than, window_us),
        "capture_id string, a string, b string, items bigint, open_us bigint, close_us bigint",
    )
    return found.withColumnsRenamed({"a": a, "b": b})


class Beacons(Waiting):
    """Number, mean and squared deviations of a pair's gaps, by running updates in order of time."""

    memory = "n bigint, first bigint, last bigint, mean double, squares double, told boolean"
    wait_us = 0

    def __init__(self, above: int, deviation_us: float):
        self.above, self.deviation_us = above, deviation_us

    def settle(self, key, waiting: list[tuple], settled_us: int):
        n, first, last, mean, squares, told = (
            self.known.get() if self.known.exists() else (0, 0, 0, 0.0, 0.0, False)
        )
        cut = next((i for i, (t,) in enumerate(waiting) if t >= settled_us), len(waiting))
        for (t,) in waiting[:cut]:
            n += 1
            if n == 1:
                first = t
            else:
                gap = t - last
                delta = gap - mean
                mean += delta / (n - 1)
                squares += delta * (gap - mean)
            last = t
        deviation = (squares / (n - 2)) ** 0.5 if n > 2 else float("inf")
        beacons = n > self.above and deviation < self.deviation_us
        self.known.update((n, first, last, mean, squares, beacons))
        found = None
        if cut and (beacons or told):
            columns = [
                "capture_id", "src_ip", "dst_ip", "n", "first_us", "last_us", "mean_gap_us", "std_gap_us", "beacons",
            ]
            found = pd.DataFrame([(*key, n, first, last, mean, deviation, beacons)], columns=columns)
        left = waiting[cut:]
        return found, left, left[0][0] if left else settled_us


def beacon_stream(
    packets: DataFrame,
    above: int = 5,
    deviation_s: float = 5.0,
    lateness: str = LATENESS,
    closing: DataFrame | None = None,
) -> DataFrame:
    """Gap statistics of pairs that beacon so far; a pair gives one row per batch that moves it.

    The row with the greatest `n` is a pair's latest one. A pair that no longer beacons gives a last row without
    `beacons`.
    """
    rows = timed(packets.select("capture_id", "src_ip", "dst_ip", "ts_us"), lateness, closing)
    return _keyed(
        rows,
        ["capture_id", "src_ip", "dst_ip"],
        Beacons(above, deviation_s * 1e6),
        "capture_id string, src_ip string, dst_ip string, n bigint, first_us bigint, "
        "last_us bigint, mean_gap_us double, std_gap_us double, beacons boolean",
    )
