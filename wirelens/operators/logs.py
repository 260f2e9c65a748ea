"""Log lines to log entries, for syslog and web access logs in the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import logs as L
from wirelens.schemas import LOGS
from wirelens.session import adopt, small_side


def detect_format(lines: DataFrame) -> DataFrame:
    """Format per file: that of its first decisive line. Files without one have NULL."""
    fmt = L.line_format(F.col("line"))
    return (
        lines.select("source_file", "seq", L.stripped("line").alias("line"))
        .filter(F.col("line") != "")
        .groupBy("source_file")
        .agg(F.min_by(fmt, F.when(fmt.isNotNull(), F.col("seq"))).alias("log_format"))
    )


def _entry(name: str, syslog: Column, access: Column) -> Column:
    return F.when(F.col("log_format") == "syslog", syslog).otherwise(access).alias(name)


def parse_lines(
    lines: DataFrame,
    *,
    year: int | None = None,
    tz: str = "UTC",
    per_line: bool = False,
    required: bool = False,
) -> DataFrame:
    """Entries of (capture_id, source_file, seq, line). Lines that do not match are skipped.

    The format is decided per file; with `per_line` each line is read by its own. Times that do not
    parse leave `ts_us` NULL and keep `ts_raw`. With `required`, no readable file is an error.

    Syslog times carry no year. It is `year`, or else follows from `modified`, if the lines have this column: the time
    of the file's last change, which no line is behind. With neither, a syslog line is an error.
    """
    adopt(lines.sparkSession)
    text = lines.withColumn("line", L.stripped("line")).filter(F.col("line") != "")
    if "modified" not in text.columns:
        text = text.withColumn("modified", F.lit(None).cast("timestamp"))
    if per_line:
        text = text.withColumn("log_format", L.line_format(F.col("line")))
    else:
        formats = small_side(detect_format(lines).filter(F.col("log_format").isNotNull()))
        if required and formats.isEmpty():
            raise ValueError("Unsupported log format")
        text = text.join(formats, "source_file")
    line, fmt = F.col("line"), F.col("log_format")
    split = F.when(fmt == "syslog", L.fields(line, L.SYSLOG_PATTERN, 4)).otherwise(
        L.fields(line, L.ACCESS_PATTERN, 6)
    )
    # Exploded, so that the filter behind it isn't rewritten over the line: each line is matched once.
    parts = text.select(
        "capture_id", "source_file", "seq", "line", "log_format", "modified", F.explode(F.array(split)).alias("part")
    ).filter(F.size("part") > 1)

    def part(i: int) -> Column:
        # `get` gives NULL where a filter above is evaluated before the match.
        return F.get("part", F.lit(i))

    status, path = part(4), part(3)
    fields = parts.select(
        "capture_id",
        "source_file",
        "seq",
        "log_format",
        "line",
        "modified",
        _entry("ts_raw", part(0), part(1)),
        _entry("origin", part(1), part(0)),
        _entry("service", part(2), F.lit("httpd")),
        _entry("message", part(3), F.concat(part(2), F.lit(" "), path, F.lit(" → "), status)),
        F.when(fmt == "apache", L.access_severity(status, path)).alias("access_severity"),
    )
    is_syslog = fmt == "syslog"
    message, ts_raw = F.col("message"), F.col("ts_raw")
    if year is not None:
        syslog_time = L.syslog_time_us(ts_raw, year, tz)
    else:
        unknown = F.raise_error("syslog times carry no year: pass `year`").cast("bigint")
        syslog_time = F.when(F.col("modified").isNull(), unknown).otherwise(
            L.syslog_time_before_us(ts_raw, F.col("modified"), tz)
        )
    entries = fields.select(
        "capture_id",
        "source_file",
        "seq",
        "log_format",
        "ts_raw",
        F.when(is_syslog, syslog_time)
        .otherwise(L.access_time_us(ts_raw))
        .alias("ts_us"),
        F.when(is_syslog, F.coalesce(L.first_ipv4(message), F.col("origin")))
        .otherwise(F.col("origin"))
        .alias("source_ip"),
        "message",
        F.when(is_syslog, L.syslog_severity(message))
        .otherwise(F.col("access_severity"))
        .alias("severity"),
        "service",
        F.col("line").alias("raw_line"),
    ).to(LOGS)
    # The same for filters on an entry's fields.
    return entries.select(F.explode(F.array(F.struct("*"))).alias("entry")).select("entry.*")


def error_entries(entries: DataFrame) -> DataFrame:
    """Entries worth a look: medium counts as an error in access logs only."""
    severe = F.col("severity").isin("critical", "high")
    return entries.filter(
        severe | ((F.col("log_format") == "apache") & (F.col("severity") == "medium"))
    )


def log_summary(entries: DataFrame) -> DataFrame:
    """Per file: format, entries, errors, and the raw times of its first and last entry."""
    is_error = F.col("severity").isin("critical", "high") | (
        (F.col("log_format") == "apache") & (F.col("severity") == "medium")
    )
    return (
        entries.groupBy("capture_id", "source_file", "log_format")
        .agg(
            F.count("*").alias("entry_count"),
            F.count_if(is_error).alias("error_count"),
            F.min_by("ts_raw", "seq").alias("first_ts"),
            F.max_by("ts_raw", "seq").alias("last_ts"),
        )
        .withColumn("time_range", F.concat_ws(" – ", "first_ts", "last_ts"))
        .drop("first_ts", "last_ts")
    )
