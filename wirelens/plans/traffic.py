"""Inputs that several operators share, built once per analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import net
from wirelens.schemas import LOGS, empty
from wirelens.session import adopt, scratch_table, small_side

MINUTE_US = 60_000_000
LARGE_PAYLOAD = 100  # bytes; a larger DNS payload is oversized


def _measures() -> dict:
    """What one packet adds to the measures of its contact."""
    tcp = net.is_protocol("TCP")
    large_dns = net.is_dns() & (F.col("payload_size") > LARGE_PAYLOAD)
    return {
        "n": F.lit(1).cast("bigint"),
        "n_tcp": F.when(tcp, 1).otherwise(0).cast("bigint"),
        "n_syn_only": F.when(tcp & net.is_syn_only(), 1).otherwise(0).cast("bigint"),
        "n_xmas": F.when(net.is_xmas(), 1).otherwise(0).cast("bigint"),
        "n_dns": F.when(net.is_dns(), 1).otherwise(0).cast("bigint"),
        "n_large_dns": F.when(large_dns, 1).otherwise(0).cast("bigint"),
        "large_dns_bytes": F.when(large_dns, F.col("payload_size")).otherwise(0).cast("bigint"),
        "large_dns_first_us": F.when(large_dns, F.col("ts_us")),
        "large_dns_last_us": F.when(large_dns, F.col("ts_us")),
        "first_us": F.col("ts_us"),
        "last_us": F.col("ts_us"),
    }


_SUMS = ["n", "n_tcp", "n_syn_only", "n_xmas", "n_dns", "n_large_dns", "large_dns_bytes"]
_MINS = ["large_dns_first_us", "first_us"]
_MAXS = ["large_dns_last_us", "last_us"]
# Arrival extremes per kind of packet: earliest and latest `seq`, and the time each carries.
_ARRIVALS = ["tcp", "xmas", "any"]
_CONTACT_KEY = ["capture_id", "src_ip", "dst_ip", "dst_port", "protocol", "minute"]
_TROUBLE = ["seq", "ts_us", "source_ip", "message", "severity", "service"]


def _is_trouble() -> Column:
    return (F.col("severity") != "info") & F.col("ts_us").isNotNull()


def as_contacts(packets: DataFrame) -> DataFrame:
    """Every packet as a contact of its own: the contact columns by projection."""
    kinds = {"tcp": net.is_protocol("TCP"), "xmas": net.is_xmas(), "any": F.lit(True)}
    arrivals = {}
    for kind, test in kinds.items():
        arrivals[f"{kind}_seq0"] = F.when(test, F.col("seq"))
        arrivals[f"{kind}_seq1"] = F.when(test, F.col("seq"))
        arrivals[f"{kind}_us0"] = F.when(test, F.col("ts_us"))
        arrivals[f"{kind}_us1"] = F.when(test, F.col("ts_us"))
    named = {"minute": F.expr(f"ts_us div {MINUTE_US}"), **_measures(), **arrivals}
    return packets.select(
        "capture_id",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "protocol",
        *[value.alias(name) for name, value in named.items()],
    )


def roll_up(contacts: DataFrame, *keys: str) -> DataFrame:
    """Contact measures at coarser keys. Unused measures are pruned from the plan."""
    aggs = [F.sum(c).alias(c) for c in _SUMS]
    aggs += [F.min(c).alias(c) for c in _MINS] + [F.max(c).alias(c) for c in _MAXS]
    for kind in _ARRIVALS:
        aggs += [
            F.min_by(f"{kind}_us0", f"{kind}_seq0").alias(f"{kind}_us0"),
            F.max_by(f"{kind}_us1", f"{kind}_seq1").alias(f"{kind}_us1"),
            F.min(f"{kind}_seq0").alias(f"{kind}_seq0"),
            F.max(f"{kind}_seq1").alias(f"{kind}_seq1"),
        ]
    return contacts.groupBy(*keys).agg(*aggs)


@dataclass
class Traffic:
    """Packets and log entries of any number of captures.

    `contacts` is either the packets seen as one-packet contacts (a projection), or, after
    `prepared()`, one row per (source, destination, port, protocol, minute) written once and read by
    every rule and summary that only needs those measures. Log entries are then parsed once, too.
    """

    packets: DataFrame
    logs: DataFrame | None = None
    _contacts: DataFrame | None = field(default=None, repr=False)
    _origins: DataFrame | None = field(default=None, repr=False)
    _troubles: DataFrame | None = field(default=None, repr=False)
    _entries: DataFrame | None = field(default=None, repr=False)
    is_prepared: bool = False

    def __post_init__(self) -> None:
        adopt(self.packets.sparkSession)

    @property
    def contacts(self) -> DataFrame:
        if self._contacts is None:
            self._contacts = as_contacts(self.packets)
        return self._contacts

    @property
    def spark(self):
        return self.packets.sparkSession

    def prepared(self) -> Traffic:
        """The same traffic with the contact table written out, for running many rules."""
        table = scratch_table(roll_up(as_contacts(self.packets), *_CONTACT_KEY), "contacts")
        troubles = self.kept_troubles if self.logs is not None else None
        return Traffic(
            self.packets, self.logs, table, self._origins, troubles, self._entries, is_prepared=True
        )

    @property
    def kept_troubles(self) -> DataFrame:
        """`troubles` written once, for operators that go over them several times.

        All entries are in the table, those below `info` without their details, so that `entries` counts them there.
        """
        if self._troubles is None:
            entries = self.logs if self.logs is not None else empty(self.spark, LOGS)
            kept = entries.select(
                "capture_id",
                "source_file",
                F.coalesce(_is_trouble(), F.lit(False)).alias("is_trouble"),
                *[F.when(_is_trouble(), F.col(c)).alias(c) for c in _TROUBLE],
            )
            self._entries = scratch_table(kept, "entries")
            self._troubles = self._entries.filter("is_trouble").select("capture_id", *_TROUBLE)
        return self._troubles

    @property
    def entries(self) -> DataFrame | None:
        """`capture_id` and `source_file` of every log entry; None without logs."""
        return (self.logs if self._entries is None else self._entries) if self.logs is not None else None

    @property
    def troubles(self) -> DataFrame:
        """Timed log entries above `info`: all that rules and features look at."""
        if self._troubles is not None:
            return self._troubles
        entries = self.logs if self.logs is not None else empty(self.spark, LOGS)
        return entries.filter(_is_trouble()).select("capture_id", *_TROUBLE)

    @property
    def origins(self) -> DataFrame:
        """Earliest and latest packet time per capture, broadcastable while captures are few."""
        if self._origins is None:
            self._origins = small_side(
                self._bounds()
            )
        return self._origins

    def _bounds(self) -> DataFrame:
        first, last = "ts_us", "ts_us"
        rows = self.packets
        if self._contacts is not None:
            rows, first, last = self._contacts, "first_us", "last_us"
        return rows.groupBy("capture_id").agg(
            F.min(first).alias("origin_us"), F.max(last).alias("end_us")
        )

    def anchored(
        self, df: DataFrame, width_us: int, ts: str = "ts_us", how: str = "inner"
    ) -> DataFrame:
        """`df` with `w`, the index of its tumbling window counted from the capture's origin."""
        offset = F.col(ts) - F.col("origin_us")
        whole = offset - F.pmod(offset, F.lit(width_us))
        return df.join(self.origins, "capture_id", how).withColumn(
            "w", F.call_function("div", whole, F.lit(width_us).cast("bigint"))
        )
