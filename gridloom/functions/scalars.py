"""Scalar expressions: header numbers, letters, longitudes, times and names, as DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def restore_year(yy: Column) -> Column:
    """Two-digit years: below 40 in the 2000s, else in the 1900s; years from 1900 on stay."""
    return F.when(yy >= 1900, yy).when(yy < 40, yy + 2000).otherwise(yy + 1900)


def letter_to_thousands(c: Column) -> Column:
    """A is 1000, Z is 26000, anything else 0."""
    return F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 64) * 1000).otherwise(0)


def thousands_to_letter(v: Column) -> Column:
    """The letter of a multiple of 1000; `9` for none."""
    return F.when(v == 0, F.lit("9")).otherwise(F.char((v / 1000).cast("int") + 64))


def grid_thousands(n: Column) -> Column:
    return F.floor(n / 1000) * 1000


def grid_rest(n: Column) -> Column:
    return n % 1000


def record_length(nx: Column, ny: Column) -> Column:
    return nx * ny + 50


def wrap_lon(lon: Column) -> Column:
    """Longitudes in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def scientific(x: Column) -> Column:
    """A number in 14 characters with a mantissa in [0.1, 1), e.g. ` 0.5039370E+00`."""
    e = F.floor(F.log10(F.abs(x))) + 1
    sign = F.when(e < 0, F.lit("-")).otherwise(F.lit("+"))
    text = F.concat(F.lpad(F.format_string("%.7f", x / F.pow(F.lit(10.0), e)), 10, " "), F.lit("E"), sign, F.lpad(F.abs(e).cast("string"), 2, "0"))
    return F.when(x == 0, F.lit(" 0.0000000E+00")).otherwise(text)


def checksum(total: Column) -> Column:
    """The rotating checksum of a sum of bytes: 0 for 0, else 1 to 255."""
    return F.when(total == 0, 0).otherwise((total - 1) % 255 + 1)


def header_time(yy: Column, month: Column, day: Column, hour: Column, minute: Column | int = 0) -> Column:
    minute = minute if isinstance(minute, Column) else F.lit(minute)
    return F.make_timestamp_ntz(restore_year(yy), month, day, hour, minute, F.lit(0))


def index_forecast(explicit: Column, forecasts: Column) -> Column:
    """Aggregate: the stated forecast, else the least one that is not negative, else -1."""
    return F.coalesce(F.max(explicit), F.min(F.when(forecasts >= 0, forecasts)), F.lit(-1))
