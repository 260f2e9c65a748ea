"""Time-window primitives that stay distributed when one key holds most of the rows.

All of them cut a key's time line into fixed slots first. What has to be seen in order is then
either one slot of one key (at most one row per distinct microsecond) or one row per slot of a key
(at most the number of slots in the recorded time), never all rows of a key.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.session import broadcast_table, measured_table, scratch_table

FOLD_ROWS = 100_000


def slot(width_us: int, ts: str = "ts_us") -> Column:
    return F.expr(f"{ts} div {width_us}")


# --- forward sliding window, first hit ------------------------------------------------------


def first_burst(
    events: DataFrame, keys: list[str], threshold: int, window_us: int, ts: str = "ts_us"
) -> DataFrame:
    """Per key, the first event whose following window (inclusive) holds `threshold` events.

    Returns keys, `burst_n`, `first_us`, `last_us`. A slot as long as the window can hold the first
    hit only if it and its successor together reach the threshold, and no slot after the first one
    that reaches it alone can. These candidates are few; only their events are ordered. An event is a
    hit if the one `threshold - 1` places after it lies in its window, so each row looks at one other
    row; of events at one time, `threshold` are as good as more. The hit's window is added up afterwards.
    """
    counted = events.groupBy(*keys, slot(window_us, ts).alias("slot")).agg(
        F.count("*").alias("slot_n")
    )
    ordered = Window.partitionBy(*keys).orderBy("slot")
    whole = Window.partitionBy(*keys)
    follower = F.when(
        F.lead("slot").over(ordered) == F.col("slot") + 1, F.lead("slot_n").over(ordered)
    ).otherwise(0)
    certain = F.min(F.when(F.col("slot_n") >= threshold, F.col("slot"))).over(whole)
    candidates = (
        counted.withColumns({"reach": F.col("slot_n") + follower, "certain": certain})
        .filter(F.col("reach") >= threshold)
        .filter(F.col("certain").isNull() | (F.col("slot") <= F.col("certain")))
        .select(*keys, "slot")
    )
    table, size = measured_table(candidates, "burst-slots")
    wanted = broadcast_table(table, size["n"]).select(
        *keys,
        F.col("slot").alias("home"),
        F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"),
    )
    ticks = (
        events.withColumn("slot", slot(window_us, ts))
        .join(wanted, [*keys, "slot"])
        .repartition(*keys, "home")  # serves the grouping and the window; few events share a time
        .groupBy(*keys, "home", "slot", F.col(ts).alias("t"))
        .agg(F.count("*").alias("c"))
    )
    single = F.explode(F.array_repeat(F.lit(1), F.least("c", F.lit(threshold)).cast("int")))
    reaches = F.lead("t", threshold - 1).over(Window.partitionBy(*keys, "home").orderBy("t"))
    hits = (
        ticks.select(*keys, "home", "slot", "t", single.alias("one"))
        .withColumn("reaches", reaches)
        .filter((F.col("slot") == F.col("home")) & (F.col("reaches") <= F.col("t") + window_us))
        .groupBy(*keys)
        .agg(F.min("t").alias("first_us"), F.min("home").alias("home"))
    )
    return (
        ticks.join(hits, [*keys, "home"])
        .filter(F.col("t").between(F.col("first_us"), F.col("first_us") + window_us))
        .groupBy(*keys, "first_us")
        .agg(F.sum("c").alias("burst_n"), F.max("t").alias("last_us"))
        .select(*keys, "burst_n", "first_us", "last_us")
    )


# --- gaps between consecutive events --------------------------------------------------------


def gap_statistics(
    events: DataFrame, keys: list[str], ts: str = "ts_us", slot_us: int = 10_000_000
) -> DataFrame:
    """Per key: `n` events, `first_us`, `last_us`, mean gap and sample deviation in microseconds.

    Gaps inside a slot are taken there and summarised; gaps between slots are taken on the slot
    summaries. The mean is the span over the number of gaps, so squared deviations are summed
    around it without cancellation. Equal times are gaps of zero.
    """
    placed = events.select(*keys, slot(slot_us, ts).alias("slot"), F.col(ts).alias("t"))
    # One exchange serves the ticks, the window and the slots; few events share a time.
    ticks = placed.repartition(*keys, "slot").groupBy(*keys, "slot", "t").agg(F.count("*").alias("c"))
    inside = Window.partitionBy(*keys, "slot").orderBy("t")
    slots = (
        ticks.withColumn("gap", F.col("t") - F.lag("t").over(inside))
        .groupBy(*keys, "slot")
        .agg(
            F.sum("c").alias("n"),
            F.sum(F.col("c") - 1).alias("ties"),
            F.min("t").alias("lo"),
            F.max("t").alias("hi"),
            F.count("gap").alias("gap_n"),
            F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"),
            F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("gap_var"),
        )
    )
    ordered = Window.partitionBy(*keys).orderBy("slot")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = (F.max("hi").over(whole) - F.min("lo").over(whole)) / F.nullif(
        F.sum("n").over(whole) - 1, F.lit(0)
    )
    placed = slots.withColumns(
        {"between": F.col("lo") - F.lag("hi").over(ordered), "mean_gap": mean}
    )
    squares = (
        F.col("gap_n") * (F.col("gap_var") + F.pow(F.col("gap_mean") - F.col("mean_gap"), F.lit(2)))
        + F.col("ties") * F.col("mean_gap") * F.col("mean_gap")
        + F.coalesce(F.pow(F.col("between") - F.col("mean_gap"), F.lit(2)), F.lit(0.0))
    )
    return (
        placed.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("first_us"),
            F.max("hi").alias("last_us"),
            F.max("mean_gap").alias("mean_gap_us"),
            F.sum(squares).alias("squares"),
        )
        .withColumn("std_gap_us", F.sqrt(F.col("squares") / F.nullif(F.col("n") - 2, F.lit(0))))
        .drop("squares")
    )


# --- greedy anchored windows ----------------------------------------------------------------


def occupied_runs(
    items: DataFrame, keys: list[str], more_than: int, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Slots of those runs of adjacent occupied slots where a window may hold enough items.

    `items` has one row per (keys, slot, item) with first_us, last_us and n. An empty slot means a
    gap longer than the window, which always restarts the walk, so runs are independent. A window
    touches at most two adjacent slots, which bounds its number of distinct items.

    A run is cut into `block`s of whole slots, each up to the one that exceeds `fold_rows` events. Of a block's first
    slot and the next, `behind` and `second_behind` name the block before.
    """
    # Without a time or a key no event joins a run.
    slots = items.dropna(subset=[*keys, "slot"]).groupBy(*keys, "slot").agg(
        F.count("*").alias("slot_items"),
        F.sum("n").alias("slot_n"),
        F.min("first_us").alias("slot_first_us"),
    )
    ordered = Window.partitionBy(*keys).orderBy("slot")
    starts = F.lag("slot").over(ordered).isNull() | (
        F.lag("slot").over(ordered) < F.col("slot") - 1
    )
    follower = F.when(
        F.lead("slot").over(ordered) == F.col("slot") + 1, F.lead("slot_items").over(ordered)
    ).otherwise(0)
    marked = slots.withColumns(
        {"run_start": F.when(starts, F.col("slot")), "reach": F.col("slot_items") + follower}
    )
    run = F.max("run_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    in_run = Window.partitionBy(*keys, "run")
    walked = in_run.orderBy("slot")
    before = F.sum("slot_n").over(walked.rowsBetween(Window.unboundedPreceding, -1))
    in_blocks = (
        marked.withColumn("run", run)
        .withColumns(
            {
                "run_reach": F.max("reach").over(in_run),
                "block": F.call_function(
                    "div", F.coalesce(before, F.lit(0)), F.lit(max(fold_rows, 1)).cast("bigint")
                ),
            }
        )
        .filter(F.col("run_reach") > more_than)
    )
    behind = F.lag("block").over(walked)
    return (
        in_blocks.withColumns(
            {"starts_run": behind.isNull(), "behind": F.when(behind != F.col("block"), behind)}
        )
        .withColumns(
            {
                "second_behind": F.lag("behind").over(walked),
                "run_blocks": F.count("behind").over(in_run) + 1,
            }
        )
        .select(
            *keys, "slot", "run", "run_blocks", "block", "behind", "second_behind", "starts_run",
            "slot_first_us",
        )
    )


# Rows of a block, in the order in which they come at one time.
STARTS, OWN, NEXT = 0, 1, 2


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` (keys, run, block, t, kind, entry) dealt and sorted by block; `place` counts from 1 in each."""
    group = [*keys, "run", "block"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy("t", "kind"))
    return rows.withColumn("place", place).sortWithinPartitions(*group, "t", "kind")


def _whole_blocks(
    batches: Iterator[pa.RecordBatch], names: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole blocks, many at a time: a row of `names` for each, and for each row its block, t, kind and entry."""
    heads: list[pa.RecordBatch] = []
    held: list[list[np.ndarray]] = []

    def joined():
        first, t, kind, entry = (np.concatenate(part) for part in zip(*held))
        return pa.Table.from_batches(heads), np.cumsum(first) - 1, t, kind, entry

    for batch in batches:
        first, t, kind, entry = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "t", "kind", "entry")
        )
        first = first == 1
        starts = np.flatnonzero(first)
        cut = starts[-1] if len(starts) else 0
        if len(starts):
            held.append([part[:cut] for part in (first, t, kind, entry)])
            heads.append(batch.select(names).take(pa.array(starts[:-1])))
            if sum(len(part[0]) for part in held):
                yield joined()
            heads, held = [batch.select(names).take(pa.array(starts[-1:]))], []
        held.append([part[cut:] for part in (first, t, kind, entry)])
    if held:
        yield joined()


def _following(
    block: np.ndarray, t: np.ndarray, window_us: int
) -> tuple[np.ndarray, np.ndarray]:
    """Times on one line, blocks further apart than a window, and where the first time behind each window stands."""
    opens = np.flatnonzero(np.diff(block, prepend=-1))
    spans = np.append(t[opens[1:] - 1], t[-1:]) - t[opens]
    line = t - t[opens][block] + (np.cumsum(spans + window_us + 1) - spans)[block]
    return line, np.searchsorted(line, line + window_us, side="right")


def _hops_of_blocks(batches, names: list[str], window_us: int):
    """Where the walk from each entry of a block first opens a window behind the block."""
    for heads, block, t, kind, entry in _whole_blocks(batches, names):
        _, to = _following(block, t, window_us)
        stays = np.append(kind == OWN, False)
        of = np.append(block, -1)
        while (moves := stays[to] & (of[to] == block)).any():
            to[moves] = to[to[moves]]
        found = np.flatnonzero(entry & (of[to] == block))
        yield from (
            heads.take(pa.array(block[found]))
            .append_column("t", pa.array(t[found]))
            .append_column("next_t", pa.array(t[to[found]]))
            .to_batches()
        )


def _windows_of_blocks(batches, names: list[str], window_us: int):
    """The windows that open in each block from its start on."""
    for heads, block, t, kind, _ in _whole_blocks(batches, names):
        starts = kind == STARTS
        line, to = _following(block, t, window_us)
        stays = np.append(kind != NEXT, False)
        of = np.append(block, -1)
        at, opened = np.flatnonzero(starts), []
        while len(at):
            opened.append(at)
            ahead = to[at]
            at = ahead[stays[ahead] & (of[ahead] == block[at])]
        rows = np.concatenate([np.empty(0, np.int64), *opened])
        yield from (
            heads.take(pa.array(block[rows]))
            .append_column("open_us", pa.array(t[rows]))
            .append_column("close_us", pa.array(t[to[rows] - 1]))
            .to_batches()
        )


def _entered(ticks: DataFrame, runs: DataFrame, keys: list[str], window_us: int, blocks: int) -> DataFrame:
    """Where the walks through runs of several blocks enter each of them: (keys, run, block, t).

    A block is left for a time of the slot behind it or the first time of the slot after that, so these alone are
    entries. Each block says for its own entries where its walk leaves to; what the start of a run reaches over these
    hops follows by pointer doubling, in rounds logarithmic in the number of blocks. After a round only what is
    reached and times at which some hop lands are followed: those alone come up again.
    """
    rkeys = [*keys, "run"]
    schema = ticks.select(*rkeys, "t", F.col("t").alias("next_t")).schema
    hops = _in_blocks(ticks, keys).mapInArrow(
        lambda batches: _hops_of_blocks(batches, rkeys, window_us), schema
    )
    reached = runs.filter("starts_run").select(*rkeys, F.col("slot_first_us").alias("t"))
    for _ in range(max(1, math.ceil(math.log2(blocks + 1)))):
        hops = scratch_table(hops, "run-hops")
        ahead = reached.join(hops, [*rkeys, "t"]).select(*rkeys, F.col("next_t").alias("t"))
        reached = scratch_table(reached.unionByName(ahead).distinct(), "run-openings")
        landed = hops.select(*rkeys, F.col("next_t").alias("t")).unionByName(reached).distinct()
        onward = hops.select(*rkeys, F.col("t").alias("next_t"), F.col("next_t").alias("after_t"))
        hops = (
            landed.join(hops, [*rkeys, "t"])
            .join(onward, [*rkeys, "next_t"])
            .select(*rkeys, "t", F.col("after_t").alias("next_t"))
        )
    entries = ticks.filter("entry").select(*rkeys, "block", "t")
    return entries.join(reached, [*rkeys, "t"]).select(*rkeys, "block", "t")


def greedy_windows(
    events: DataFrame,
    items: DataFrame,
    keys: list[str],
    more_than: int,
    window_us: int,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Items of the greedy windows of each key: (keys, open_us, close_us, item).

    A window opens at the first event, takes every event up to `window_us` later (inclusive), and
    the next event opens the next one. Only runs that could hold more than `more_than` distinct
    items in a window are walked, block by block: a task holds the times of one, at most `fold_rows` events and
    one slot, and of the slot behind it. Where walks enter the blocks of longer runs is found first, by `_entered`.
    """
    rkeys = [*keys, "run"]
    runs, size = measured_table(
        occupied_runs(items, keys, more_than, fold_rows), "runs", blocks=F.max("run_blocks")
    )
    kept = broadcast_table(runs, size["n"])
    at_first = F.col("ts_us") == F.col("slot_first_us")
    ahead = F.when(at_first, F.col("second_behind"))
    is_entry = F.col("behind").isNotNull() | ahead.isNotNull() | (at_first & F.col("starts_run"))
    times = (
        events.withColumn("slot", slot(window_us))
        .join(kept, [*keys, "slot"])
        .select(
            *rkeys, "run_blocks", "block", "behind", ahead.alias("ahead"), is_entry.alias("entry"),
            F.col("ts_us").alias("t"),
        )
        .distinct()
    )
    is_long = F.col("run_blocks") > 1
    long = (size["blocks"] or 0) > 1
    if long:
        times = scratch_table(times, "run-ticks")

    def row(block: str, kind: int, entry: Column):
        return F.struct(
            F.col(block).alias("block"), F.lit(kind).alias("kind"), entry.alias("entry")
        )

    # A block's own times, and those behind it that a window of its may reach or lead to.
    roles = F.array(
        row("block", OWN, F.col("entry")), row("behind", NEXT, F.lit(False)), row("ahead", NEXT, F.lit(False))
    )
    ticks = (
        times.select(*rkeys, "run_blocks", "t", F.explode(roles).alias("x"))
        .select(*rkeys, "run_blocks", "t", "x.*")
        .filter(F.col("block").isNotNull())
    )
    first = F.col("slot_first_us").alias("t")
    starts = runs.filter("starts_run").select(*rkeys, "block", first)
    if long:
        found = _entered(
            ticks.filter(is_long).drop("run_blocks"), runs.filter(is_long), keys, window_us, size["blocks"]
        )
        starts = runs.filter(F.col("starts_run") & ~is_long).select(*rkeys, "block", first).unionByName(found)
    started = starts.withColumns({"kind": F.lit(STARTS), "entry": F.lit(False)})
    opening = runs.select(*keys, first.alias("open_us"), first.alias("close_us")).schema
    windows = _in_blocks(ticks.drop("run_blocks").unionByName(started), keys).mapInArrow(
        lambda batches: _windows_of_blocks(batches, keys, window_us), opening
    )
    spread = windows.withColumn(
        "slot",
        F.explode(F.sequence(slot(window_us, "open_us"), slot(window_us, "close_us"))),
    )
    # Inside one slot a window is a head or a tail of the slot, so first and last time decide.
    return (
        items.join(spread, [*keys, "slot"])
        .filter((F.col("last_us") >= F.col("open_us")) & (F.col("first_us") <= F.col("close_us")))
        .select(*keys, "open_us", "close_us", "item")
        .distinct()
    )
