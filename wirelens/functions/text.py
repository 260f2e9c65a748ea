"""Text forms: ISO times, and numbers printed to a number of digits.

`format_number` with a pattern rounds half to even on the binary value, which is the rounding the
alert texts need; Spark's `round` and `format_string` round half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fixed(value: Column | str, digits: int) -> Column:
    """Number with `digits` decimals and no grouping."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", _col(value).cast("double"), F.lit(pattern))


def rounded(value: Column | str, digits: int) -> Column:
    """`value` as a double rounded half to even at `digits` decimals."""
    return fixed(value, digits).cast("double")


def grouped(value: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.call_function("format_number", _col(value).cast("bigint"), F.lit(0))


def plain(value: Column | str) -> Column:
    return _col(value).cast("string")


def iso_time(ts_us: Column | str) -> Column:
    """`2026-03-15T10:00:00+00:00`, with six fraction digits only when they are not all zero."""
    us = _col(ts_us)
    ts = F.timestamp_micros(us)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(us % 1_000_000 != 0, F.date_format(ts, "'.'SSSSSS")).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def iso_to_us(text: Column | str) -> Column:
    """Microseconds of an ISO time text; NULL when it does not parse."""
    return F.unix_micros(F.try_to_timestamp(_col(text)))


def seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def json_of(**fields: Column) -> Column:
    """JSON object with the fields in the order given."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
