"""Clock times: text to minutes and back. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^(\d{1,2}):(\d{2})"
DAY_START, DAY_END, SLOT_MINUTES = 480, 1320, 30


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, pattern, k).try_cast("int")


def display_time(c: Column) -> Column:
    """8:00am -> 08:00 AM; anything else is trimmed."""
    pattern = r"(?i)^(\d{1,2}):(\d{2})(am|pm)"
    t = F.trim(c)
    return F.when(t.rlike(pattern), F.concat(F.lpad(F.regexp_extract(t, pattern, 1), 2, "0"), F.lit(":"), F.regexp_extract(t, pattern, 2), F.lit(" "), F.upper(F.regexp_extract(t, pattern, 3)))).otherwise(t)


def _minutes(t: Column, pattern: str) -> Column:
    hour = _part(t, pattern, 1)
    half = F.lower(F.regexp_extract(t, pattern, 3))
    hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return hour * 60 + _part(t, pattern, 2)


def minutes(c: Column) -> Column:
    """Minutes of a clock time in 12 or 24 hours; 0 if it is none."""
    pattern = r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)?"
    return F.coalesce(F.when(F.trim(c).rlike(pattern), _minutes(F.trim(c), pattern)), F.lit(0))


def minutes_ui(c: Column) -> Column:
    """As the calendar reads times: missing is 8:00, malformed is 0; without am or pm exactly two parts are wanted."""
    t = F.trim(c)
    half = r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)"
    parts = F.split(t, ":")
    number = lambda k: F.regexp_extract(F.get(parts, F.lit(k)), r"^\s*([+-]?\d+)", 1).try_cast("int")
    plain = F.when(F.size(parts) == 2, number(0) * 60 + number(1))
    return F.when(c.isNull() | (c == ""), F.lit(DAY_START)).otherwise(F.coalesce(F.when(t.rlike("(?i)am|pm"), F.when(t.rlike(half), _minutes(t, half))).otherwise(plain), F.lit(0)))


def clock(m: Column) -> Column:
    """Minutes as HH:MM."""
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def clock_label(m: Column) -> Column:
    """Minutes as h:MM AM."""
    h = F.floor(m / 60)
    shown = F.when(h == 0, F.lit(12)).when(h > 12, h - 12).otherwise(h)
    return F.concat(shown.cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(h >= 12, F.lit(" PM")).otherwise(F.lit(" AM")))


def grid_slot(c: Column) -> Column:
    """Half-hour slot from 8:00; -1 outside 8:00 to 22:00 (22:00 itself is the last)."""
    m = minutes_ui(c)
    return F.when((m < DAY_START) | (m > DAY_END), F.lit(-1)).otherwise(F.floor((m - DAY_START) / SLOT_MINUTES).cast("int"))


def stored_time(c: Column) -> Column:
    """A time as HH:MM; missing is 00:00."""
    return F.when(c.isNull() | (c == ""), F.lit("00:00")).otherwise(clock(minutes_ui(c)))


def bare_time(c: Column) -> Column:
    """Upper case without AM and PM, trimmed."""
    t = F.upper(F.trim(c))
    return F.trim(F.replace(F.replace(t, F.lit("AM"), F.lit("")), F.lit("PM"), F.lit("")))
