"""Calendar expressions on zone-free timestamps.

Nothing here goes through the session time zone: ``date_trunc`` would, so hours
and days are rebuilt from their parts.
"""

from __future__ import annotations


from pyspark.sql import Column, functions as F

from gridevents.schema import MONTHS

#: Text form of a stamp in list files.
STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def parse_stamp(text: Column) -> Column:
    """Timestamp of a text stamp, NULL where it is blank or malformed."""
    return text.try_cast("timestamp_ntz")


def stamp_text(time: Column) -> Column:
    return F.date_format(time, STAMP_FORMAT)


def hour_key(time: Column) -> Column:
    """The stamp cut to its hour."""
    zero = F.lit(0)
    return F.make_timestamp_ntz(F.year(time), F.month(time), F.day(time), F.hour(time), zero, zero)


def year_start(year: Column) -> Column:
    one, zero = F.lit(1), F.lit(0)
    return F.make_timestamp_ntz(year, one, one, zero, zero, zero)


def hours_after(start: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), start)


def month_number(name: str) -> int:
    """1..12 of a month abbreviation."""
    return MONTHS.index(name) + 1


def month_number_of(name: Column) -> Column:
    """Column form of :func:`month_number`; unknown names give NULL."""
    pairs = [F.lit(x) for i, m in enumerate(MONTHS, start=1) for x in (m, i)]
    return F.try_element_at(F.create_map(*pairs), name)
