"""Keys, aliases and slugs. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of activity types.
TYPE_ALIASES = {
    "lec": "Lecture", "lecture": "Lecture", "lectuer": "Lecture",
    "lab": "Lab", "laboratory": "Lab",
    "tut": "Tutorial", "tutorial": "Tutorial", "tute": "Tutorial",
    "sem": "Seminar", "seminar": "Seminar",
    "wrk": "Workshop", "workshop": "Workshop",
}

# Day labels as they stand on rotated pages. The full Wednesday and its abbreviation are here in both spellings.
REVERSED_DAYS = {
    "yadnoM": "Monday", "noM": "Monday",
    "yadseuT": "Tuesday", "euT": "Tuesday",
    "yadsendew": "Wednesday", "yadsendeW": "Wednesday", "eW": "Wednesday", "deW": "Wednesday",
    "yadsruhT": "Thursday", "uhT": "Thursday",
    "yadirF": "Friday", "irF": "Friday",
    "yadrutaS": "Saturday", "taS": "Saturday",
    "yadnuS": "Sunday", "nuS": "Sunday",
}

# Hour labels that a page should have, in order.
EXPECTED_LABELS = ("08:00AM", "09:00AM", "10:00AM", "11:00AM", "12:00PM", "01:00PM", "02:00PM", "03:00PM", "04:00PM", "05:00PM", "06:00PM", "07:00PM", "08:00PM", "09:00PM")

# Spellings of week days, once a trailing s is gone.
DAY_SPELLINGS = {
    "mon": "monday", "monday": "monday",
    "tue": "tuesday", "tuesday": "tuesday",
    "wed": "wednesday", "wednesday": "wednesday",
    "thu": "thursday", "thur": "thursday", "thursday": "thursday",
    "fri": "friday", "friday": "friday",
    "sat": "saturday", "saturday": "saturday",
    "sun": "sunday", "sunday": "sunday",
}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Exact look-up in a fixed table; null if absent."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def activity(c: Column) -> Column:
    """Canonical type of a spelling, or Other."""
    return F.coalesce(lookup(F.lower(F.trim(c)), TYPE_ALIASES), F.lit("Other"))


def day_of_label(c: Column) -> Column:
    return lookup(c, REVERSED_DAYS)


def weekday(c: Column) -> Column:
    """Week day of a spelling, or null."""
    return lookup(F.regexp_replace(F.lower(F.trim(c)), "s+$", ""), DAY_SPELLINGS)


def type_key(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("-"), label)).otherwise(F.lit("")))


def safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "")


def stream_id(kind: Column, day: Column, start: Column, end: Column, label: Column) -> Column:
    """Type, day, times without their first colon and label, joined by dashes."""
    digits = lambda t: F.regexp_replace(t, "^([^:]*):", "$1")
    tail = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("-"), safe(label))).otherwise(F.lit(""))
    return F.concat(safe(activity(kind)), F.lit("-"), safe(day), F.lit("-"), digits(start), F.lit("-"), digits(end), tail)


def course_slug(title: Column) -> Column:
    """Upper case, white space as dashes, other signs gone."""
    return safe(F.regexp_replace(F.upper(title), r"\s+", "-"))
