"""URL rules by a sort-merge range join: a sorted sweep with a stack of active nested rules.

A rule is a host and a start of a path; it fits the host and its subdomains. In the canonical key, a
reversed host followed by a path, a rule is an interval: everything that starts with the rule's key. A
url has one key for each suffix of its host that some rule names. Rules of one host are nested or apart,
so a sweep over the sorted keys keeps a stack: a rule's start pushes it, its end pops it, and a url takes
the top, the longest rule that fits. The longest over the url's host suffixes wins.

The sweep is a window over the merged rows; as a window function has no stack of its own, each rule event
carries the stack's top after it (the rule itself, or at its end the one that encloses it, found by the
same sweep over rules). Urls are distinct before the sweep. A hot host is dealt out over salts of about
`SWEEP_ROWS` urls, to each of which the host's rules are copied; more rules make the salts larger, so that
copies stay a small share. Everything is DataFrame functions.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule. Repeated
rows are all judged. Of equal rules the one with the smallest verdict ("allow") counts. With no rules
every url gets the default. An empty table gives no rows. Ports and user names are part of the host text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.session import broadcast_table, measured_table

SWEEP_ROWS = 256
#: Paths are compared as UTF-8 bytes. This byte is in none and stands behind the path at an interval's end.
AFTER = bytearray([0xFF])
#: Rule events up to this number are broadcast; more are joined by shuffle.
BROADCAST_EVENTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _suffixes(host: Column) -> Column:
    """The host and everything after each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _sweep(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`top`: the top of the stack at each row, from the last event before it in key order."""
    order = Window.partitionBy(*keys).orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.last("opens", ignorenulls=True).over(order))


def _events(rules: DataFrame) -> DataFrame:
    """Starts and ends of all rules in key order, each with the stack's top after it.

    The ends of nested rules come from the inside out, so that the top after an end is the next
    enclosing rule. It is found by a join of each rule with the starts of its own path, which gives one
    row for each enclosing rule.
    """
    named = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("suffix"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict"),
    ).groupBy("suffix", "path").agg(F.min("verdict").alias("verdict"))
    rule = F.struct(
        (F.length("suffix") + F.length("path")).alias("length"),
        F.concat("suffix", "path").alias("rule"),
        F.col("verdict"),
    )
    named = named.select("suffix", "path", rule.alias("self"))
    starts = named.select(
        "suffix",
        "path",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", 1, n))).alias("start"),
    ).where("start != path")
    enclosing = (
        starts.join(named.select("suffix", F.col("path").alias("start"), F.col("self").alias("outer")), ["suffix", "start"])
        .groupBy("suffix", "path")
        .agg(F.max("outer").alias("outer"))
    )
    nothing = F.struct(F.lit(-1).alias("length"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    whole = named.join(enclosing, ["suffix", "path"], "left")
    whole = whole.withColumn("path", F.encode("path", "UTF-8"))
    opens = whole.select("suffix", "path", F.lit(0).alias("kind"), F.col("self").alias("opens"))
    closes = whole.select(
        "suffix",
        F.concat("path", F.lit(AFTER)).alias("path"),
        F.lit(2).alias("kind"),
        F.coalesce("outer", nothing).alias("opens"),
    )
    return opens.union(closes)


def longest_rules(urls: DataFrame, rules: DataFrame, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """(url, length, rule, verdict) for every distinct url of `urls` that some rule fits.

    `rules` has host, path and verdict.
    """
    events, seen = measured_table(_events(rules), "url-rules")

    def small(df: DataFrame) -> DataFrame:
        return broadcast_table(df, seen["n"], BROADCAST_EVENTS)

    distinct = urls.select("url").where("url is not null").distinct()
    probes = distinct.select(
        "url",
        F.explode(_suffixes(host_of(F.col("url")))).alias("suffix"),
        F.encode(path_of(F.col("url")), "UTF-8").alias("path"),
    )
    per_host = events.groupBy("suffix").agg(F.count("*").alias("n_events"))
    probes = probes.join(small(per_host.select("suffix")), "suffix", "left_semi")
    n_salts = F.ceil(F.col("n") / F.greatest(F.lit(sweep_rows), 16 * F.col("n_events")))
    salts = probes.groupBy("suffix").agg(F.count("*").alias("n")).join(small(per_host), "suffix").select("suffix", n_salts.cast("int").alias("salts"))
    dealt = probes.join(small(salts), "suffix").select(
        "suffix",
        F.pmod(F.xxhash64("url"), F.col("salts")).cast("int").alias("salt"),
        "path",
        F.lit(1).alias("kind"),
        F.lit(None).cast(events.schema["opens"].dataType).alias("opens"),
        "url",
    )
    copied = events.join(small(salts), "suffix").select(
        "suffix",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        "path",
        "kind",
        "opens",
        F.lit(None).cast("string").alias("url"),
    )
    swept = _sweep(dealt.union(copied).withColumn("key", reversed_host(F.col("suffix"))), ["key", "salt"])
    fits = swept.where("kind = 1 and top.length >= 0").groupBy("url").agg(F.max("top").alias("top"))
    return fits.select("url", "top.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row."""
    urls = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    found = longest_rules(urls, rules)
    return urls.join(found, "url", "left").select(
        F.col("page_id").alias(key),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
