"""Dates as responses print them, as column expressions over wall clocks without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from disclens.functions.text import strip

ISO = r"^(\d{4})-(\d{2})-(\d{2})"
US = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _iso_day(text: Column) -> Column:
    """`YYYY-MM-DD` from an ISO or US date at the start of the text."""
    iso = F.concat_ws("-", *[_part(text, ISO, g) for g in (1, 2, 3)])
    us = F.concat_ws(
        "-", _part(text, US, 3), F.lpad(_part(text, US, 1), 2, "0"), F.lpad(_part(text, US, 2), 2, "0")
    )
    return F.when(text.rlike(ISO), iso).when(text.rlike(US), us)


def _clock(text: Column) -> Column:
    hour = F.lpad(_part(text, CLOCK, 1), 2, "0")
    seconds = F.coalesce(_part(text, CLOCK, 3), F.lit("00"))
    return F.when(text.rlike(CLOCK), F.concat(hour, F.lit(":"), _part(text, CLOCK, 2), F.lit(":"), seconds))


def ts_normalise(date: Column, time: Column) -> Column:
    """EXT-09: one sortable wall clock; a zeroed placeholder never beats a real clock."""
    day = strip(date)
    rest = F.regexp_replace(F.regexp_replace(day, ISO, ""), US, "")
    own, embedded = _clock(strip(time)), _clock(rest)
    zero = F.lit("00:00:00")
    clock = (
        F.when(own != zero, own)
        .when(embedded.isNotNull() & (own.isNull() | (embedded != zero)), embedded)
        .otherwise(F.coalesce(own, zero))
    )
    return F.concat(_iso_day(day), F.lit("T"), clock)


def serial_date(cell: Column, date1904: bool = False) -> Column:
    """EXT-10: a spreadsheet day count or a printed date; date only where the cell has no clock."""
    text = strip(cell)
    serial = F.when(text.rlike(r"^\d+(?:\.\d+)?$"), text.try_cast("double"))
    # A date past the year 9999 is no date; the bound also keeps the day count an integer.
    counted = F.when((serial >= 1) & (serial < 2958466), F.rint(serial * 86400).cast("bigint"))
    days = F.floor(counted / 86400).cast("int")
    rest = F.pmod(counted, F.lit(86400))
    epoch = F.to_date(F.lit("1904-01-01" if date1904 else "1899-12-30"))
    day = F.date_format(F.date_add(epoch, days), "yyyy-MM-dd")
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    clock = F.concat(
        F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"),
        two(F.pmod(rest, F.lit(60))),
    )
    from_serial = F.concat(day, F.when(rest == 0, F.lit("")).otherwise(clock))
    printed = F.date_format(F.try_to_date(_iso_day(text), "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.when(serial.isNotNull(), from_serial).otherwise(printed)


def capture_date(mmddyy: Column) -> Column:
    """Six digits MMDDYY as an ISO date of this century, or NULL where they are no date."""
    iso = F.concat(
        F.lit("20"), F.substring(mmddyy, 5, 2), F.lit("-"), F.substring(mmddyy, 1, 2), F.lit("-"),
        F.substring(mmddyy, 3, 2),
    )
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def day_number(day: Column) -> Column:
    """`YYYY-MM-DD` as the integer YYYYMMDD, which orders the same and aggregates without sorting."""
    return F.replace(day, F.lit("-"), F.lit("")).cast("int")


def day_text(number: Column) -> Column:
    text = F.lpad(number.cast("string"), 8, "0")
    return F.concat(
        F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2)
    )
