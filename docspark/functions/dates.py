"""Dates of spreadsheet cells: which number formats show one, and serial numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of built-in formats that show dates or times, first and last.
DATE_FORMATS = [(14, 22), (27, 36), (45, 45), (47, 47), (50, 58)]
# Days between the two date systems, milliseconds of a day, and the day after the
# last one, 9999-12-31.
DAYS_1904, DAY, LAST_SERIAL = 1462, 86_400_000, 2_958_466

_QUIET = r'"[^"]*"|\\.|[_*].|\[[^\]]*\]'  # texts, single characters, widths, colours and places


def is_date_format(number: Column, code: Column) -> Column:
    """True if a format shows a date or a time of day.

    ``code`` is the format's text, NULL for a built-in one. Formats with elapsed time,
    such as ``[h]:mm``, show durations and no dates.
    """
    built_in = F.lit(False)
    for first, last in DATE_FORMATS:
        built_in |= number.between(first, last)
    elapsed = code.rlike(r"(?i)\[(h+|m+|s+)\]")
    shown = F.regexp_replace(code, _QUIET, "")
    return F.coalesce(shown.rlike("(?i)[dmyhs]") & ~elapsed & (F.lower(shown) != "general"), built_in)


def serial_date(serial: Column, since_1904: Column) -> Column:
    """A serial number as ISO text, to the millisecond; NULL if it is no number or no date.

    Whole days are ``2024-03-05``, others ``2024-03-05T06:30:00``, and serials below one day
    are a time alone, ``06:30:00``. Day 0 is 1899-12-30, and 1904-01-01 in the other system, so
    that all dates from 1900-03-01 on are those that spreadsheets show.
    """
    days = serial.try_cast("double")
    moved = F.when(since_1904, days + DAYS_1904).otherwise(days)
    moment = F.round(moved * DAY).cast("bigint")
    rest = F.pmod(moment, F.lit(DAY))
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.call_function("div", moment - rest, F.lit(DAY)).cast("int"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    part = lambda size, of: F.pmod(F.call_function("div", rest, F.lit(size)), F.lit(of))
    thousandths = F.pmod(rest, F.lit(1000))
    time = F.concat(
        two(part(3_600_000, 24)),
        F.lit(":"),
        two(part(60_000, 60)),
        F.lit(":"),
        two(part(1000, 60)),
        F.when(thousandths > 0, F.concat(F.lit("."), F.lpad(thousandths.cast("string"), 3, "0"))).otherwise(""),
    )
    iso = day.cast("string")
    text = (
        F.when((days < 1) & (rest > 0), time)
        .when(rest == 0, iso)
        .otherwise(F.concat(iso, F.lit("T"), time))
    )
    return F.when((days >= 0) & (moved < LAST_SERIAL) & ~F.isnan(days), text)
