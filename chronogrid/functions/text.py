"""Fields out of block text, and small text helpers. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import bound

# Types looked for in a block, its labels, and what ends a value.
ACTIVITY_TYPES = ("Lecture", "Lab", "Tutorial", "Postgraduate")
FIELD = r"(?s)(Course|Staff|Room):\s*(.*?)(?=(?:Course|Staff|Room):|$)"
NOISE = r"(?s)\s*(?:Wks|\[=|\(L\d).*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def block_text(words: Column) -> Column:
    """Text of a block's words, as they stand: lines by rounded top, words of a line by (top, x0).

    words: array of structs with top, x0, seq and text.
    """
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(F.bround(w["top"], 0).alias("line"), w["top"].alias("top"), w["x0"].alias("x0"), w["seq"].alias("seq"), w["text"].alias("text"))))
    joined = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("double").alias("line"), F.lit("").alias("text")),
        lambda acc, w: F.struct(w["line"].alias("line"), F.when(acc["line"].isNull(), w["text"]).otherwise(F.concat(acc["text"], F.when(acc["line"] == w["line"], F.lit(" ")).otherwise(F.lit("\n")), w["text"])).alias("text")),
    )
    return joined["text"]


def repair_weeks(t: Column) -> Column:
    """Close the blank in week ranges such as S2W7- S2W12."""
    return F.regexp_replace(t, r"(S\d+W\d+)-\s+(S\d+W\d+)", "$1-$2")


def activity_type(t: Column, types: Column | None = None) -> Column:
    """The first listed type that stands in the text as a word; types, if not empty, overrides the usual ones."""
    usual = F.coalesce(*(F.when(t.rlike(rf"(?i)\b{x}\b"), F.lit(x)) for x in ACTIVITY_TYPES))
    if types is None:
        return usual
    listed = F.get(F.filter(types, lambda x: F.regexp_like(t, F.concat(F.lit(r"(?i)\b\Q"), x, F.lit(r"\E\b")))), F.lit(0))
    return F.when(F.size(F.coalesce(types, F.array().cast("array<string>"))) > 0, listed).otherwise(usual)


def weeks(t: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(t, r"S\d+W\d+-S\d+W\d+", 0)), blank_to_null(F.regexp_extract(t, r"SUM W\d+-SUM W\d+", 0)))


def week_count(t: Column) -> Column:
    return F.regexp_extract(t, r"\[=(\d+)\]", 1).try_cast("int")


def group_label(t: Column) -> Column:
    n = F.regexp_extract(t, r"\(L(\d+)\)", 1)
    return F.when(n != "", F.concat(F.lit("L"), n))


def labelled_fields(t: Column) -> Column:
    """Struct of course, staff and room: text after the last such label up to the next label or noise; empty is null.

    The text is cut at its labels once for all three.
    """
    said = lambda cut, name: F.try_element_at(F.filter(cut, lambda x: x.startswith(f"{name}:")), F.lit(-1))
    value = lambda cut, name: bound(strip(F.regexp_replace(F.substr(said(cut, name), F.lit(len(name) + 2)), NOISE, "")), lambda v: F.when(v != "", v))
    return bound(F.regexp_extract_all(t, F.lit(FIELD), F.lit(0)), lambda cut: F.struct(*(value(cut, n).alias(n.lower()) for n in ("Course", "Staff", "Room"))))


def room_name(v: Column) -> Column:
    """A room without one trailing single capital or digit."""
    return strip(F.regexp_replace(v, r"\s+[A-Z0-9]\s*$", ""))


def parse_block(t: Column, types: Column | None = None) -> Column:
    """All fields of a block's text as a struct.

    Fields are read from the lines joined by blanks, with week ranges repaired, so
    none holds a line break; raw_text is the text as it stands, with its lines.
    """

    def fields(raw: Column, t: Column) -> Column:
        return bound(labelled_fields(t), lambda said: F.struct(
            activity_type(t, types).alias("type"), weeks(t).alias("weeks"), week_count(t).alias("week_count"), said["course"].alias("course"),
            said["staff"].alias("staff"), room_name(said["room"]).alias("room"), group_label(t).alias("group_label"), raw.alias("raw_text"),
        ))

    return bound(t, lambda raw: bound(repair_weeks(F.replace(raw, F.lit("\n"), F.lit(" "))), lambda t: fields(raw, t)))


def or_none_mark(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("_None_"))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def shortened(c: Column, most: int = 30) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 2), F.lit(".."))).otherwise(c)


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element that holds no other; empty if there is none."""
    return F.regexp_extract(html, f"<{tag}>([^<]*)</{tag}>", 1)


def is_semester(c: Column) -> Column:
    return c.startswith("Semester_") | c.startswith("Summer_")


def list_argument(c: Column) -> Column:
    """Comma-separated text as an array without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def confidence_class(c: Column, middle: str = "medium") -> Column:
    return F.when(c >= 0.8, F.lit("high")).when(c >= 0.5, F.lit(middle)).otherwise(F.lit("low"))


def json_object(c: Column) -> Column:
    """The JSON object in a reply: a fenced block, else from the first to the last brace, else all of it."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.trim(fenced) != "", fenced).otherwise(c)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(braces != "", braces).otherwise(F.trim(body))


def parse_json(c: Column, schema: str) -> Column:
    """from_json of the object in a reply; null fields where it does not parse."""
    return F.from_json(json_object(c), schema)
