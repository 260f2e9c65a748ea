"""Log-line parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two log formats: line patterns, month names, probed paths.
SYSLOG_PATTERN = r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[\d+\])?\s*:\s*(.*)"
ACCESS_PATTERN = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+)'
)
IPV4_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SCAN_PATHS = ["/admin", "/wp-admin", "/phpmyadmin", "/.env", "/config"]


BLANKS = " \t\n\r\x0b\x0c"


def stripped(line: Column | str) -> Column:
    return F.btrim(F.col(line) if isinstance(line, str) else line, F.lit(BLANKS))


def line_format(line: Column) -> Column:
    """`syslog` or `apache` for a stripped line that decides the format, NULL for another one."""
    after = F.substring(line, 4, 1)
    first_token_ends = (after == "") | F.lit(BLANKS).contains(after)
    return F.when(
        F.substring(line, 1, 3).isin(MONTHS) & first_token_ends, F.lit("syslog")
    ).when(line.rlike(ACCESS_PATTERN), F.lit("apache"))


def fields(line: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern as an array, from one pass over the line.

    A line has no newline, so it serves as the separator; a line that does not match stays whole, as one element.
    """
    template = "\n".join(f"${i + 1}" for i in range(groups)) + "\n"
    return F.split(F.regexp_replace(line, pattern, template), "\n")


def first_ipv4(message: Column) -> Column:
    """First IPv4 literal of the text, NULL without one."""
    return F.nullif(F.regexp_extract(message, IPV4_PATTERN, 0), F.lit(""))


def syslog_severity(message: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(text.contains("segfault") | text.contains("kernel panic"), "critical")
        .when(text.contains("failed password") | text.contains("authentication failure"), "high")
        .when(text.contains("error"), "medium")
        .when(text.contains("warning"), "low")
        .otherwise("info")
    )


def access_severity(status: Column, path: Column) -> Column:
    traversal = path.contains("..") | path.contains("etc/passwd") | path.contains("etc/shadow")
    probed = F.lit(False)
    for scan_path in SCAN_PATHS:
        probed = probed | path.contains(scan_path)
    return (
        F.when(traversal, "high")
        .when(status.startswith("5"), "medium")
        .when(status.isin("403", "404") & probed, "low")
        .otherwise("info")
    )


def syslog_time_us(ts: Column, year: int | Column, tz: str = "UTC") -> Column:
    """Syslog times carry neither year nor zone; both are options. NULL when not a time."""
    year = F.lit(year) if isinstance(year, int) else year
    text = F.concat(year.cast("string"), F.lit(" "), F.regexp_replace(ts, r"\s+", " "))
    local = F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))
    return F.unix_micros(F.to_utc_timestamp(local, tz))


DAY_US = 24 * 3600 * 1_000_000


def syslog_time_before_us(ts: Column, modified: Column, tz: str = "UTC") -> Column:
    """The time in the latest year that isn't behind the file's last change, by more than a day of other zones."""
    this = syslog_time_us(ts, F.year(modified), tz)
    return F.when(this <= F.unix_micros(modified) + DAY_US, this).otherwise(
        syslog_time_us(ts, F.year(modified) - 1, tz)
    )


def access_time_us(ts: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(ts, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def request_path(message: Column | str) -> Column:
    """First token that starts with a slash, without its query string."""
    tokens = F.filter(F.split(message, r"\s+"), lambda token: token.startswith("/"))
    return F.coalesce(
        F.substring_index(F.try_element_at(tokens, F.lit(1)), "?", 1), F.lit("/unknown")
    )
