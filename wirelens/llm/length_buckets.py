"""Packing into optimal length buckets.

The histogram of all lengths decides where `buckets` length classes end so that padding every document
to its class's end costs least; dynamic programming finds the best ends exactly. Inside a class, documents
form batches that hold as many as the token budget has room for at the class's padded length.

The histogram is small at any scale: lengths above 4096 are rounded up to 12 significant bits, at most
0.05 % more, so it has fewer than 2,048 entries for each doubling and about 60,000 for any 64-bit length.
Places inside a class are exact and dense (only a class's last batch has free room): documents are numbered
in slices of about `SLICE_ROWS`, and slices start where the ones before end.

Defined results: a length below 1 (or null) counts as 1; a document longer than the budget is a batch of
its own; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.session import scratch_table

SIGNIFICANT_BITS = 12
SLICE_ROWS = 512
#: Slices whose starts are added up together.
RUN_SLICES = 1024


def rounded(length: Column) -> Column:
    """The length, or the next one of `SIGNIFICANT_BITS` significant bits."""
    bits = F.length(F.bin(length - 1))
    step = F.when(bits <= SIGNIFICANT_BITS, F.lit(1)).otherwise(F.pow(F.lit(2.0), bits - SIGNIFICANT_BITS)).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def best_ends(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Ends of at most `buckets` length classes that make the padded total smallest.

    With lengths in order and C(i) documents up to the i-th, closing a class at length j after one that
    ends at i costs L(j) * (C(j) - C(i)). For a fixed number of classes the candidates i are lines in L(j)
    with falling slopes, so their lower envelope is kept and each j takes the line that is lowest for it.
    """
    histogram = sorted(histogram)
    lengths = [length for length, _ in histogram]
    counts = [0]
    for _, n in histogram:
        counts.append(counts[-1] + n)
    size = len(lengths)
    if size <= buckets:
        return lengths
    cost = [length * c for length, c in zip(lengths, counts[1:])]
    chosen = [[-1] * size]
    for _ in range(1, buckets):
        lines: list[tuple[int, int, int]] = []  # slope, height, last length of the class before
        at, now, back = 0, list(cost), [-1] * size
        for j in range(size):
            while at + 1 < len(lines) and _height(lines[at + 1], lengths[j]) <= _height(lines[at], lengths[j]):
                at += 1
            if lines:
                found = _height(lines[at], lengths[j]) + lengths[j] * counts[j + 1]
                if found < now[j]:
                    now[j], back[j] = found, lines[at][2]
            line = (-counts[j + 1], cost[j], j)
            while len(lines) >= 2 and _never_lowest(lines[-2], lines[-1], line):
                lines.pop()
            lines.append(line)
            at = min(at, len(lines) - 1)
        cost = now
        chosen.append(back)
    ends, j = [], size - 1
    for back in reversed(chosen):
        ends.append(lengths[j])
        j = back[j]
        if j < 0:
            break
    return ends[::-1]


def _height(line: tuple[int, int, int], x: int) -> int:
    return line[0] * x + line[1]


def _never_lowest(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(
    docs: DataFrame, length: Column, key: str = "doc_id", buckets: int = 16, budget: int = 65_536
) -> DataFrame:
    """(key, n_tokens, bucket, padded_length, batch, slot) of every row.

    Buckets count from 0, batches from 0 in each bucket, slots from 0 in each batch.
    """
    sized = F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1))
    rows = scratch_table(
        docs.select(F.col(key).alias("doc_id"), sized.alias("n_tokens")).withColumn("rounded", rounded(F.col("n_tokens"))),
        "lengths",
    )
    histogram = [(r["rounded"], r["count"]) for r in rows.groupBy("rounded").count().collect()]
    ends = best_ends(histogram, buckets) or [1]
    inside = [sum(n for size, n in histogram if low < size <= high) for low, high in zip([0, *ends], ends)]

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)

    ordered = F.xxhash64("doc_id", "n_tokens")
    sliced = rows.withColumn(
        "bucket", sum((F.col("rounded") > end).cast("int") for end in ends[:-1]) + F.lit(0)
    ).withColumn("slice", F.pmod(ordered, of_bucket([-(-n // SLICE_ROWS) or 1 for n in inside])))
    numbered = sliced.withColumn(
        "place", F.row_number().over(Window.partitionBy("bucket", "slice").orderBy(ordered, "doc_id", "n_tokens")) - 1
    )
    starts = _starts(sliced.groupBy("bucket", "slice").agg(F.count("*").alias("n")))
    at = F.col("start") + F.col("place")
    room = of_bucket([max(1, budget // end) for end in ends])
    return numbered.join(starts, ["bucket", "slice"]).select(
        F.col("doc_id").alias(key),
        "n_tokens",
        "bucket",
        of_bucket(ends).alias("padded_length"),
        F.floor(at / room).cast("long").alias("batch"),
        F.pmod(at, room).cast("long").alias("slot"),
    )


def _starts(counts: DataFrame) -> DataFrame:
    """`start` of every slice: rows of the slices before it in its bucket, added up in two steps."""
    counts = counts.withColumn("run", F.floor(F.col("slice") / RUN_SLICES))
    in_run = Window.partitionBy("bucket", "run").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    of_runs = Window.partitionBy("bucket").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        counts.groupBy("bucket", "run").agg(F.sum("n").alias("n")).select("bucket", "run", F.coalesce(F.sum("n").over(of_runs), F.lit(0)).alias("base"))
    )
    inner = counts.select("bucket", "run", "slice", F.coalesce(F.sum("n").over(in_run), F.lit(0)).alias("inner"))
    return inner.join(runs, ["bucket", "run"]).select("bucket", "slice", (F.col("base") + F.col("inner")).alias("start"))
