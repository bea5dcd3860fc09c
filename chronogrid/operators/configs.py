"""Layout configurations: derived from entries, taken from a reply, compared and described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import weekday
from ..functions.numbers import exact_round
from ..functions.text import confidence_class
from ..functions.times import bare_time, minutes
from ..functions.values import bound
from ..schemas import CONFIG, DAYS

# What a configuration has where nothing better is known.
ROOM_PATTERN = r"[A-Z0-9]{2,5}\.\d{2}\.\d{2}[A-Z]?"
STAFF_PATTERN = r"[A-Z][a-z]+,\s*[A-Z]\."
CODE_PATTERN = r"[A-Z]{2,4}\d{4}"
REGIONS = ("header_top", "header_bottom", "table_top", "table_bottom", "footer_bottom")
PATTERNS = ("module_code_regex", "room_pattern", "staff_pattern", "activity_types")
SLOT_MAP = "array<struct<label:string,top:double,bottom:double>>"


def default_regions() -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in (("header_top", 0.0), ("header_bottom", 0.15), ("table_top", 0.15), ("table_bottom", 0.85), ("footer_bottom", 0.92))))


def default_patterns() -> Column:
    return F.struct(F.lit(CODE_PATTERN).alias("module_code_regex"), F.lit(ROOM_PATTERN).alias("room_pattern"), F.lit(STAFF_PATTERN).alias("staff_pattern"), F.array(*map(F.lit, ("Lecture", "Tutorial", "Lab", "Practical", "Workshop"))).alias("activity_types"))


def with_defaults(section: Column, defaults: Column, names: tuple[str, ...]) -> Column:
    """A section of a reply with the default of each field that it lacks; all defaults where there is no section."""
    return F.struct(*(F.coalesce(section[n], defaults[n]).alias(n) for n in names))


def derived_columns(entries: Column) -> Column:
    """Equal day columns in the order in which days are first met; an array of structs (day, left, right)."""
    days = F.array_distinct(F.filter(F.transform(entries, lambda e: weekday(e["day"])), lambda d: d.isNotNull()))
    edge = lambda i, n: bound(i / n, lambda x: exact_round(x, 4))
    return bound(days, lambda ds: F.transform(ds, lambda d, i: F.struct(d.alias("day"), edge(i, F.size(ds)).alias("left"), edge(i + 1, F.size(ds)).alias("right"))))


def day_columns(columns: Column) -> Column:
    """The array form as a struct with a nullable column for each week day."""
    one = lambda cs, d: F.get(F.transform(F.filter(cs, lambda c: c["day"] == d), lambda c: F.struct(c["left"].alias("left"), c["right"].alias("right"))), F.lit(0))
    return bound(columns, lambda cs: F.struct(*(one(cs, d).alias(d) for d in DAYS)))


def derived_slots(entries: Column, twelve_hours: bool = True) -> Column:
    """Distinct time ranges in order of start, as fractions of a day.

    With twelve_hours 02:00 PM is 14:00; without, AM and PM are stripped and it is
    2:00, as configurations made earlier have it.
    """
    usable = F.filter(entries, lambda e: F.coalesce(e["start_time"], F.lit("")) != "")
    label = lambda e: F.trim(F.concat(e["start_time"], F.lit(" - "), F.coalesce(e["end_time"], F.lit(""))))

    def fraction(t: Column) -> Column:
        if twelve_hours:
            return F.when(F.trim(t).rlike(r"^\d{1,2}:\d{2}"), minutes(t) / 1440)
        parts = F.split(bare_time(t), ":")
        return F.when(F.size(parts) == 2, (F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")) / 1440)

    rows = F.transform(usable, lambda e, i: F.struct(label(e).alias("label"), fraction(e["start_time"]).alias("top"), fraction(F.coalesce(e["end_time"], F.lit(""))).alias("bottom"), i.alias("i")))
    rows = F.filter(rows, lambda r: r["top"].isNotNull() & r["bottom"].isNotNull())
    by_label = F.array_sort(F.transform(rows, lambda r: F.struct(r["label"].alias("label"), r["i"].alias("i"), r["top"].alias("top"), r["bottom"].alias("bottom"))))
    first = bound(by_label, lambda rs: F.filter(rs, lambda r, k: (k == 0) | (F.get(rs, k - 1)["label"] != r["label"])))
    ordered = F.array_sort(F.transform(first, lambda r: F.struct(r["top"].alias("top"), r["i"].alias("i"), r["bottom"].alias("bottom"), r["label"].alias("label"))))
    return F.transform(ordered, lambda r: F.struct(r["label"].alias("label"), r["top"].alias("top"), r["bottom"].alias("bottom")))


def generate(df: DataFrame, extraction: str, layout: str, twelve_hours: bool = True) -> DataFrame:
    """df with config: each section of the layout reply where it is there, else derived from the entries or the default.

    Regions and patterns take the default field by field, as a reply may have some of them only.

    extraction: struct with entries; layout: struct of the configuration's form, may be null.
    """
    entries, l = F.col(extraction)["entries"], F.col(layout)  # noqa: E741
    entries = F.coalesce(entries, F.array().cast("array<struct<day:string,start_time:string,end_time:string,room:string,activity_type:string,staff:string>>"))
    config = F.struct(
        with_defaults(l["page_regions"], default_regions(), REGIONS).alias("page_regions"),
        F.coalesce(l["day_columns"], day_columns(derived_columns(entries))).alias("day_columns"),
        F.coalesce(l["time_slot_map"], derived_slots(entries, twelve_hours)).alias("time_slot_map"),
        with_defaults(l["text_patterns"], default_patterns(), PATTERNS).alias("text_patterns"),
        F.coalesce(l["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(l["layout_signature"], F.lit("")).alias("layout_signature"),
    )
    return df.withColumn("config", config.cast(CONFIG))


def config_documents(df: DataFrame, config_id: Column, course_code: Column, session_id: Column | None = None) -> DataFrame:
    """Rows to append to the configurations: drafts whose version follows the order of ids within a course.

    The course code is stored in upper case, as look-ups take it.
    """
    code = F.upper(F.coalesce(course_code, F.lit("unknown")))
    none = F.lit(None).cast("string")
    out = df.select(config_id.alias("config_id"), F.lower(code).alias("course_id"), code.alias("course_code"), F.lit("draft").alias("status"), F.lit("llm").alias("generated_by"), (session_id if session_id is not None else none).alias("llm_session_id"), "config", none.alias("rejection_reason"), F.current_timestamp().alias("created_at"))
    return out.withColumn("version", F.row_number().over(Window.partitionBy("course_code").orderBy("config_id")))


def summary(configs: DataFrame, middle: str = "medium") -> DataFrame:
    """What reports show of each configuration: day and slot counts, first and last slot, the first six and how many more, confidence class."""
    c = F.col("config")
    days = F.filter(F.array(*(F.when(c["day_columns"][d].isNotNull(), F.lit(d)) for d in DAYS)), lambda d: d.isNotNull())
    labels = F.transform(c["time_slot_map"], lambda s: s["label"])
    return configs.select("config_id", "course_code", "version", "status", F.size(days).alias("n_days"), F.array_join(days, ", ").alias("days"), F.size(labels).alias("n_slots"), F.try_element_at(labels, F.lit(1)).alias("first_slot"), F.try_element_at(labels, F.lit(-1)).alias("last_slot"), F.array_join(F.slice(labels, 1, 6), ", ").alias("slots_shown"), F.greatest(F.size(labels) - 6, F.lit(0)).alias("slots_more"), F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence"), confidence_class(F.coalesce(c["confidence"], F.lit(0.0)), middle).alias("confidence_class"))


def compare_days(a: Column, b: Column) -> Column:
    """For all week days that either configuration has, in order: day, both columns and same, changed, added, removed."""
    def one(d: str) -> Column:
        x, y = a["day_columns"][d], b["day_columns"][d]
        change = F.when(x.isNull(), F.lit("added")).when(y.isNull(), F.lit("removed")).when(x.eqNullSafe(y), F.lit("same")).otherwise(F.lit("changed"))
        return F.when(x.isNotNull() | y.isNotNull(), F.struct(F.lit(d).alias("day"), x.alias("before"), y.alias("after"), change.alias("change")))

    return F.array_compact(F.array(*map(one, sorted(DAYS))))


def compare(a: Column, b: Column) -> Column:
    """Region differences (a - b), slot-count difference, day comparison and the sections that changed."""
    sections = ("page_regions", "day_columns", "time_slot_map", "text_patterns")

    def compared(a: Column, b: Column) -> Column:
        deltas = F.struct(*(bound(a["page_regions"][r] - b["page_regions"][r], lambda x: exact_round(x, 4)).alias(r) for r in REGIONS))
        changed = F.array_compact(F.array(*(F.when(~a[s].eqNullSafe(b[s]), F.lit(s)) for s in sections)))
        return F.struct(deltas.alias("region_deltas"), (F.size(a["time_slot_map"]) - F.size(b["time_slot_map"])).alias("slot_delta"), compare_days(a, b).alias("days"), changed.alias("changed"))

    return bound(F.struct(a.alias("a"), b.alias("b")), lambda both: compared(both["a"], both["b"]))
