"""Queries that run whole plans over pages, entries and logs laid out from the given tables.

Each item of ``part`` is laid out as a page with hour and day labels, boxes and
words, or as entries; where these stand follows from the item's key and size, so
the SQL gives the expected records directly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text, times
from ..functions.numbers import exact_round
from ..operators import configs, layout, nearest, records
from ..schemas import CONFIG, CONFIG_DOCUMENT, PAGES, RECTS, SESSION_EVENT, SLOTS, WORDS
from ..session import load, shared_dir, spread
from ..sinks import files
from ..sources import pages as pages_source
from ..sources import resources
from ..streaming import sessions
from . import audit, calibrate, compare, extract, week
from .catalog import E, _events, query


def _cast(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ddl.split(", ")))


def _rows(df: DataFrame, keep: list[str], items: list[Column]) -> DataFrame:
    """A row for each item that is not null, numbered by seq."""
    return df.select(*keep, F.posexplode(F.array_compact(F.array(*items))).alias("seq", "w")).select(*keep, "seq", "w.*")


def _laid_out(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, rects, pages with a config): a page for each item, four pages a file."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = load(spark, folder, "part").withColumns({"file": F.concat(F.lit("m"), F.floor(k / 4).cast("string"), F.lit(".pdf")), "page": (k % 4 + 1).cast("int"), "bx": 100.0 + 100 * (s % 3), "by": 150.0 + 150 * (k % 3)})
    p = spread(p, "file", "page")

    def word(t: Column | str, x: Column | float, top: Column | float, width: float = 20.0) -> Column:
        t, x, top = (F.lit(v) if not isinstance(v, Column) else v for v in (t, x, top))
        return F.struct(t.alias("text"), x.cast("double").alias("x0"), (x + width).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 8).cast("double").alias("bottom"))

    bx, by = F.col("bx"), F.col("by")
    kind = F.get(F.array(*map(F.lit, ("Lecture,", "Lab,", "Tutorial,", "Talk"))), (k % 4).cast("int"))
    words = [F.when(s % 2 == 0, word(F.concat(F.lit("Semester_"), F.col("page").cast("string")), 70.0, 20.0)), word("Course", 70.0, 40.0), word("timetable", 100.0, 41.0), word(F.col("p_brand"), 150.0, 42.0)]
    words += [word("08:00AM", 100.0 + F.when(k % 97 == 0, 20.0).otherwise(0.0), 100.0), word("09:00AM", 200.0, 100.0), word("10:00AM", 300.0, 100.0), word("01:00PM", 400.0, 100.0)]
    words += [word("yadnoM", 30.0, 150.0), word("yadseuT", 30.0, 300.0), word("yadirF", 30.0, 450.0)]
    words += [word(kind, bx + 5, by + 2), word("Course:", bx + 5, by + 12), word(F.col("p_brand"), bx + 30, by + 12), word("Room:", bx + 5, by + 22), word(F.col("p_type"), bx + 30, by + 22), word("S1W1-", bx + 5, by + 32), word("S1W12", bx + 5, by + 42), word("[=12]", bx + 30, by + 42)]
    rect = lambda x, top, width, fill: F.struct(x.cast("double").alias("x0"), (x + width).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), F.lit(width).alias("width"), F.lit(fill).alias("fill"))
    rects = [rect(bx, by, 100.0, True), rect(bx + 2, by + 12, 90.0, True), rect(bx, by + 60, 100.0, False), rect(bx, by + 90, 15.0, True)]
    slot = lambda bottom: F.array(F.struct(F.lit("x").alias("label"), F.lit(0.5).alias("top"), F.lit(bottom).cast("double").alias("bottom")))
    day = lambda right: F.struct(F.lit(0.2).alias("left"), F.lit(right).cast("double").alias("right"))
    none = F.lit(None)
    config = lambda slots, monday: F.struct(none.alias("page_regions"), F.struct(monday.alias("monday"), *(none.alias(d) for d in ("tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))).alias("day_columns"), slots.alias("time_slot_map"), none.alias("text_patterns"), F.lit(0.5).alias("confidence"), F.lit("").alias("layout_signature")).cast(CONFIG)
    pages = p.select("file", "page", F.lit(800.0).alias("width"), F.lit(600.0).alias("height"), F.when(k % 5 == 0, config(slot(0.6), none)).when(k % 5 == 1, config(slot(None), day(None))).when(k % 5 == 2, config(F.array().cast("array<struct<label:string,top:double,bottom:double>>"), day(0.9))).alias("config"))
    return _cast(_rows(p, ["file", "page"], words), WORDS), _cast(_rows(p, ["file", "page"], rects), RECTS), pages


_L = """(SELECT *, 'm' || (p_partkey // 4) || '.pdf' AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, p_size % 3 AS c, ['Monday', 'Tuesday', 'Friday'][CAST(p_partkey % 3 + 1 AS BIGINT)] AS day,
['08:00 AM', '09:00 AM', '10:00 AM', '01:00 PM'] AS hours, CASE WHEN p_size % 3 = 0 AND p_partkey % 97 = 0 THEN '08:00 AM' ELSE hours[p_size % 3 + 1] END AS start_time, hours[p_size % 3 + 2] AS end_time,
['Lecture', 'Lab', 'Tutorial', NULL][CAST(p_partkey % 4 + 1 AS BIGINT)] AS type, p_brand AS course, p_type AS room FROM part)"""
_RAW = "['Lecture,', 'Lab,', 'Tutorial,', 'Talk'][CAST(p_partkey % 4 + 1 AS BIGINT)] || chr(10) || 'Course: ' || p_brand || chr(10) || 'Room: ' || p_type || chr(10) || 'S1W1-' || chr(10) || 'S1W12 [=12]'"
_FIRST = "row_number() OVER (PARTITION BY file, day, start_time, end_time, course ORDER BY page) = 1"


@query(f"SELECT file, page, day, start_time, end_time, type, 'S1W1-S1W12' AS weeks, 12 AS week_count, course, room || ' S1W1-S1W12' AS room, {_RAW} AS raw_text FROM {_L} QUALIFY {_FIRST}")
def extract_entries(spark, folder):
    words, rects, pages = _laid_out(spark, folder)
    return extract.entries(words, rects, _cast(pages, PAGES)).drop("cluster_idx", "staff", "group_label")


@query(f"SELECT file, page, day, start_time, end_time, type, course FROM {_L} WHERE p_partkey % 5 <> 0 AND NOT (p_partkey % 5 = 2 AND c = 0) QUALIFY {_FIRST}")
def extract_with_configuration(spark, folder):
    return extract.entries(*_laid_out(spark, folder), config="config").select("file", "page", "day", "start_time", "end_time", "type", "course")


@query(f"""WITH e AS (SELECT * FROM {_L}), f AS (SELECT file, min(page) FILTER (p_size % 2 = 0) AS p0 FROM e GROUP BY 1), n AS (SELECT file, count(*) AS n FROM (SELECT * FROM e QUALIFY {_FIRST}) GROUP BY 1)
SELECT f.file AS source_file, CASE WHEN p0 IS NOT NULL THEN 'Semester_' || p0 END AS semester, (SELECT 'Course timetable ' || arg_max(p_brand, page) FROM e WHERE e.file = f.file AND (p0 IS NULL OR page <= p0)) AS course_title, CAST(n AS INTEGER) AS n_entries FROM f JOIN n USING (file)""")
def extract_results(spark, folder):
    words, rects, pages = _laid_out(spark, folder)
    return extract.results(words, rects, _cast(pages, PAGES)).select("source_file", "semester", "course_title", F.size("entries").alias("n_entries"))


@query(f"SELECT count(DISTINCT file) AS total_files, CAST(sum(n) AS BIGINT) AS total_entries FROM (SELECT file, count(*) AS n FROM (SELECT * FROM {_L} QUALIFY {_FIRST}) GROUP BY 1)")
def extract_totals(spark, folder):
    from ..operators.audit import totals

    words, rects, pages = _laid_out(spark, folder)
    return totals(extract.results(words, rects, _cast(pages, PAGES)))


@query("""WITH l AS (SELECT *, 'm' || (p_partkey // 4) || '.pdf' AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, unnest([0, 1, 2, 3]) AS i FROM part)
SELECT file, page, CASE WHEN i = 0 AND p_partkey % 97 = 0 THEN 120e0 ELSE 100e0 + 100 * i END AS x_start, CASE WHEN i = 3 THEN 470e0 ELSE 200e0 + 100 * i END AS x_end, ['08:00 AM', '09:00 AM', '10:00 AM', '01:00 PM'][i + 1] AS label, i AS idx FROM l""")
def hour_slots(spark, folder):
    words, _, pages = _laid_out(spark, folder)
    return layout.slot_rows(words, layout.with_limits(_cast(pages, PAGES)))


@query("""SELECT 'm' || (p_partkey // 4) || '.pdf' AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, 0 AS cluster_idx, 100e0 + 100 * (p_size % 3) AS x0, 200e0 + 100 * (p_size % 3) AS x1, 152e0 + 150 * (p_partkey % 3) AS y_top, CAST(8 AS INTEGER) AS n_words, 280e0 + 150 * (p_partkey % 3) AS y_bottom FROM part""")
def page_blocks(spark, folder):
    words, rects, pages = _laid_out(spark, folder)
    limits = layout.with_limits(_cast(pages, PAGES))
    boxes = layout.boxes(rects, limits)
    held = layout.blocks(words, boxes, limits).withColumn("n_words", F.size("words")).drop("words")
    return held.join(boxes.select("file", "page", "cluster_idx", "y_bottom"), ["file", "page", "cluster_idx"])


@query("""SELECT 'm' || (p_partkey // 4) || '.pdf' AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, '08:00AM' AS label, 100e0 AS expected_x, 120e0 AS actual_x, 20e0 AS delta, 100e0 AS top FROM part WHERE p_partkey % 97 = 0""")
def header_discrepancies(spark, folder):
    words, _, pages = _laid_out(spark, folder)
    return audit.run(words, _cast(pages, PAGES))["discrepancies"]


@query("""SELECT 'm' || (p_partkey // 4) || '.pdf' AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, '11:00AM; 12:00PM; 02:00PM; 03:00PM; 04:00PM; 05:00PM; 06:00PM; 07:00PM; 08:00PM; 09:00PM' AS missing FROM part""")
def header_missing(spark, folder):
    words, _, pages = _laid_out(spark, folder)
    return audit.run(words, _cast(pages, PAGES))["missing"].withColumn("missing", F.array_join("missing", "; "))


_PAGE = "'m' || (p_partkey // 4) || '.pdf' AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, (p_partkey // 4) % 7 = 0 AS failed"


@query(f"""WITH p AS (SELECT *, {_PAGE} FROM part), d AS (SELECT 'discrepancy' AS kind, file, page FROM p WHERE p_partkey % 97 = 0 AND NOT failed), m AS (SELECT 'missing' AS kind, file, page FROM p WHERE NOT failed), e AS (SELECT DISTINCT 'error' AS kind, file, CAST(NULL AS INTEGER) AS page FROM p WHERE failed),
a AS (SELECT * FROM d UNION ALL SELECT * FROM m UNION ALL SELECT * FROM e) SELECT * FROM a UNION ALL SELECT 'issues', CAST((SELECT count(*) FROM a) AS VARCHAR), NULL""")
def audit_with_failed_files(spark, folder):
    words, _, pages = _laid_out(spark, folder)
    failed = F.regexp_extract("file", r"m(\d+)", 1).cast("int") % 7 == 0
    errors = pages.where(failed).select("file", F.lit("cannot be read").alias("error")).distinct()
    found = audit.run(words, _cast(pages, PAGES), errors)
    at = lambda kind, df: df.select(F.lit(kind).alias("kind"), "file", "page")
    counted = found["verdict"].select(F.lit("issues").alias("kind"), F.col("issues").cast("string").alias("file"), F.lit(None).cast("int").alias("page"))
    return at("discrepancy", found["discrepancies"]).unionAll(at("missing", found["missing"])).unionAll(at("error", errors.withColumn("page", F.lit(None).cast("int")))).unionAll(counted)


@query("""SELECT p_partkey, arg_min(a.label, struct_pack(d := abs(p_size * 7.0 - a.x), i := a.i)) AS "start", arg_min(a.label, struct_pack(d := abs(p_size * 7.0 + 35 - a.x), i := a.i)) AS "end", arg_min(a.i, struct_pack(d := abs(p_size * 7.0 - a.x), i := a.i)) AS start_idx, arg_min(a.x + 60, struct_pack(d := abs(p_size * 7.0 + 35 - a.x), i := a.i)) AS end_limit
FROM part, (SELECT CAST(i AS INTEGER) AS i, i * 60e0 AS x, 'S' || i AS label FROM range(6) t(i)) a GROUP BY 1""")
def range_slots(spark, folder):
    slots = F.array(*(F.struct(F.lit(i * 60.0).alias("x_start"), F.lit(i * 60.0 + 60).alias("x_end"), F.lit(f"S{i}").alias("label"), F.lit(i).alias("idx")) for i in range(6))).cast(SLOTS)
    x = F.col("p_size") * 7.0
    r = load(spark, folder, "part").select("p_partkey", nearest.range_slots(x, x + 35, slots).alias("r"))
    return r.select("p_partkey", "r.start", "r.end", F.col("r.start_slot.idx").alias("start_idx"), F.col("r.end_slot.x_end").alias("end_limit"))


# -- comparison -------------------------------------------------------------------------------


def _extractions(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Two normalised extractions of one document for each item: two rule entries, and one of a model near the first or too far from it."""
    k = F.col("p_partkey")
    p = load(spark, folder, "part").select(k.cast("string").alias("pdf"), k, "p_brand")
    none = F.lit(None).cast("string")
    rule = lambda idx, day, start, end, kind: F.struct(F.lit(idx).alias("idx"), F.lit(day).alias("day"), F.lit(start).alias("start_time"), F.lit(end).alias("end_time"), F.concat(F.col("p_brand"), F.lit(" ")).alias("room"), F.lit("Doe, J").alias("staff"), F.lit(kind).alias("type"), F.lit("C").alias("course"), none.alias("weeks"), F.lit(None).cast("int").alias("week_count"), none.alias("group_label"))
    r = p.select("pdf", F.explode(F.array(rule(0, "Monday", "01:00 PM", "02:00 PM", "Lecture"), rule(1, "Friday", "08:00 AM", "09:30 AM", "Lab"))).alias("e")).select("pdf", "e.*")
    start = F.when(k % 2 == 0, F.lit("01:00PM")).otherwise(F.lit("03:00PM"))
    l = p.select("pdf", F.lit(0).alias("idx"), F.lit("Monday").alias("day"), start.alias("start_time"), F.lit("04:00 PM").alias("end_time"), F.when(k % 3 == 0, F.lower("p_brand")).otherwise(F.lit("elsewhere")).alias("room"), F.lit("DOE,J").alias("staff"), F.lit("Lecture").alias("activity_type"))  # noqa: E741
    return records.normalise(r, "rule"), records.normalise(l, "llm")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pdf, i AS idx, day, start_time, end_time, s AS start_minutes, e AS end_minutes, e - s AS duration_minutes, room, 'Doe, J' AS staff, kind AS activity_type, 'C' AS course, CAST(NULL AS VARCHAR) AS weeks, CAST(NULL AS INTEGER) AS week_count, CAST(NULL AS VARCHAR) AS group_label FROM (
SELECT p_partkey, 0 AS i, 'Monday' AS day, '01:00 PM' AS start_time, '02:00 PM' AS end_time, 780 AS s, 840 AS e, p_brand AS room, 'Lecture' AS kind FROM part UNION ALL SELECT p_partkey, 1, 'Friday', '08:00 AM', '09:30 AM', 480, 570, p_brand, 'Lab' FROM part)""")
def normalised_entries(spark, folder):
    return _extractions(spark, folder)[0]


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pdf, 2 AS rule_count, 1 AS llm_count, CAST(p_partkey % 2 = 0 AS INTEGER) AS matched_count, CAST(p_partkey % 2 = 0 AS INTEGER) AS disagreement_count, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS only_rule_count, CAST(p_partkey % 2 AS INTEGER) AS only_llm_count, CASE WHEN p_partkey % 2 = 0 THEN 0.5e0 ELSE 0e0 END AS match_rate FROM part""")
def compare_per_file(spark, folder):
    names = ("rule_count", "llm_count", "matched_count", "disagreement_count", "only_rule_count", "only_llm_count")
    return compare.run(*_extractions(spark, folder))["per_file"].select("pdf", *(F.col(n).cast("int").alias(n) for n in names), F.col("match_rate").cast("double").alias("match_rate"))


@query("""SELECT 2 * count(*) AS rule_count, count(*) AS llm_count, CAST(count(*) FILTER (p_partkey % 2 = 0) AS BIGINT) AS matched_count, CAST(count(*) FILTER (p_partkey % 2 = 0) AS BIGINT) AS disagreement_count, 2 * count(*) - count(*) FILTER (p_partkey % 2 = 0) AS only_rule_count, count(*) FILTER (p_partkey % 2 = 1) AS only_llm_count, 75e0 AS rule_mean_duration,
round(CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 180 ELSE 60 END) AS DOUBLE) / count(*), 6) AS llm_mean_duration FROM part""")
def compare_overall(spark, folder):
    return compare.run(*_extractions(spark, folder))["overall"].withColumn("llm_mean_duration", F.round(F.col("llm_mean_duration").cast("double"), 6)).withColumn("rule_mean_duration", F.col("rule_mean_duration").cast("double"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pdf, 'Monday' AS day, '01:00 PM' AS rule_start, '01:00PM' AS llm_start, 0 AS time_diff_min, 'C' AS rule_course, CASE WHEN p_partkey % 3 = 0 THEN 'end_time,start_time' ELSE 'end_time,room,start_time' END AS fields FROM part WHERE p_partkey % 2 = 0""")
def compare_disagreements(spark, folder):
    d = compare.run(*_extractions(spark, folder))["disagreements"]
    return d.withColumn("fields", F.array_join(F.array_sort(F.map_keys("differences")), ",")).drop("differences")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pdf, CASE WHEN p_partkey % 3 = 0 THEN 'end_time' ELSE 'end_time,room' END AS fields FROM part WHERE p_partkey % 2 = 0""")
def compare_times_as_minutes(spark, folder):
    d = compare.run(*_extractions(spark, folder), times_as_minutes=True)["disagreements"]
    return d.select("pdf", F.array_join(F.array_sort(F.map_keys("differences")), ",").alias("fields"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pdf, 'rule' AS side, 1 AS idx FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rule', 0 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'llm', 0 FROM part WHERE p_partkey % 2 = 1""")
def compare_unmatched(spark, folder):
    out = compare.run(*_extractions(spark, folder))
    return out["only_rule"].select("pdf", F.lit("rule").alias("side"), "idx").unionAll(out["only_llm"].select("pdf", F.lit("llm"), "idx"))


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'good' END AS kind, o_orderkey FROM orders")
def split_by_error(spark, folder):
    good, failed = records.split_errors(load(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "late").alias("error")))
    return good.select(F.lit("good").alias("kind"), "o_orderkey").unionAll(failed.select(F.lit("failed"), "o_orderkey"))


# -- configurations ---------------------------------------------------------------------------


def _entry(day: str, start: Column, end: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(day).alias("day"), start.alias("start_time"), end.alias("end_time"), none.alias("room"), none.alias("activity_type"), none.alias("staff"))


def _generated(spark, folder) -> DataFrame:
    """A configuration for each item from three entries; every other item has a layout reply without regions."""
    h = F.lpad((F.col("p_size") % 11 + 1).cast("string"), 2, "0")
    am = lambda m: F.concat(h, F.lit(f":{m} AM"))
    entries = F.array(_entry("Tues", F.lit("02:00 PM"), F.lit("03:00 PM")), _entry("Mon", am("00"), am("30")), _entry("tuesday", F.lit("02:00 PM"), F.lit("03:00 PM")))
    reply = F.when(F.col("p_partkey") % 2 == 0, F.lit('Here: {"confidence": 0.9, "layout_signature": "v1"}')).otherwise(F.lit("no reply"))
    df = spread(load(spark, folder, "part"), "p_partkey").select("p_partkey", F.struct(entries.alias("entries")).alias("extraction"), text.parse_json(reply, CONFIG).alias("layout"))
    return configs.generate(df, "extraction", "layout").select("p_partkey", "config")


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS header_top, 0.15::DOUBLE AS header_bottom, CASE WHEN p_partkey % 3 = 1 THEN 0.2 ELSE 0.15 END::DOUBLE AS table_top, 0.85::DOUBLE AS table_bottom, CASE WHEN p_partkey % 3 = 1 THEN 0.99 ELSE 0.92 END::DOUBLE AS footer_bottom,
CASE WHEN p_partkey % 3 = 1 THEN 'R[0-9]+' ELSE '[A-Z0-9]{2,5}\.\d{2}\.\d{2}[A-Z]?' END AS room_pattern, '[A-Z][a-z]+,\s*[A-Z]\.' AS staff_pattern, 5 AS n_types FROM part""")
def partial_layout_reply(spark, folder):
    some = F.lit('{"page_regions": {"table_top": 0.2, "footer_bottom": 0.99}, "text_patterns": {"room_pattern": "R[0-9]+"}}')
    k = F.col("p_partkey") % 3
    reply = F.when(k == 0, F.lit('{"page_regions": {"header_top": 0.1}}')).when(k == 1, some).otherwise(F.lit("{}"))
    none = F.array().cast("array<struct<day:string,start_time:string,end_time:string,room:string,activity_type:string,staff:string>>")
    made = configs.generate(load(spark, folder, "part").select("p_partkey", F.struct(none.alias("entries")).alias("extraction"), text.parse_json(reply, CONFIG).alias("layout")), "extraction", "layout")
    return made.select("p_partkey", "config.page_regions.*", "config.text_patterns.room_pattern", "config.text_patterns.staff_pattern", F.size("config.text_patterns.activity_types").alias("n_types"))


_H = "lpad(CAST(p_size % 11 + 1 AS VARCHAR), 2, '0')"


@query(f"""SELECT p_partkey, 0 AS place, {_H} || ':00 AM - ' || {_H} || ':30 AM' AS label, (p_size % 11 + 1) * 60 / 1440 AS top, ((p_size % 11 + 1) * 60 + 30) / 1440 AS bottom FROM part
UNION ALL SELECT p_partkey, 1, '02:00 PM - 03:00 PM', 840 / 1440, 900 / 1440 FROM part""")
def derived_slots(spark, folder):
    # outer, as Spark else infers a filter that there are slots, and makes all of them for it once more in the scan's few tasks
    rows = _generated(spark, folder).select("p_partkey", F.posexplode_outer("config.time_slot_map").alias("place", "s")).where("place IS NOT NULL")
    return rows.select("p_partkey", "place", "s.*")


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS config_id, upper(p_brand) AS course_code, 1 AS version, 'draft' AS status, 2 AS n_days, 'monday, tuesday' AS days, 2 AS n_slots, {_H} || ':00 AM - ' || {_H} || ':30 AM' AS first_slot, '02:00 PM - 03:00 PM' AS last_slot, first_slot || ', 02:00 PM - 03:00 PM' AS slots_shown, 0 AS slots_more,
CASE WHEN p_partkey % 2 = 0 THEN 0.9e0 ELSE 0e0 END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence_class FROM part""")
def configuration_summary(spark, folder):
    made = _generated(spark, folder).join(load(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey")
    return configs.summary(configs.config_documents(made, F.col("p_partkey").cast("string"), F.col("p_brand")).withColumn("version", F.lit(1)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS config_id, 'CUST' || o_custkey AS course_code, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS version, 'cust' || o_custkey AS course_id, 'draft' AS status FROM orders""")
def configuration_versions(spark, folder):
    o = load(spark, folder, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast(CONFIG).alias("config"))
    return configs.config_documents(o, F.col("o_orderkey").cast("string"), F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))).select("config_id", "course_code", F.col("version").cast("int").alias("version"), "course_id", "status")


@query("""SELECT p_partkey, 'monday' AS day, CASE WHEN p_partkey % 3 = 0 THEN 'removed' ELSE 'same' END AS change FROM part UNION ALL SELECT p_partkey, 'tuesday', CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'same' END FROM part UNION ALL SELECT p_partkey, 'friday', 'added' FROM part WHERE p_partkey % 3 = 0""")
def configuration_days(spark, folder):
    made = _generated(spark, folder)
    column = lambda left, right: F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"))
    other = F.col("config").withField("day_columns", F.col("config.day_columns").withField("monday", F.lit(None).cast("struct<left:double,right:double>")).withField("tuesday", column(0.5, 1.0)).withField("friday", column(0.0, 0.5)))
    b = F.when(F.col("p_partkey") % 3 == 0, other).otherwise(F.col("config"))
    return made.select("p_partkey", F.explode(configs.compare_days(F.col("config"), b)).alias("d")).select("p_partkey", "d.day", "d.change")


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS table_top_delta, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS slot_delta, CASE p_partkey % 3 WHEN 0 THEN 'page_regions' WHEN 1 THEN 'time_slot_map' ELSE '' END AS changed FROM part""")
def configuration_differences(spark, folder):
    c, k = F.col("config"), F.col("p_partkey") % 3
    b = F.when(k == 0, c.withField("page_regions", c["page_regions"].withField("table_top", F.lit(0.1)))).when(k == 1, c.withField("time_slot_map", F.slice(c["time_slot_map"], 1, 1))).otherwise(c)
    d = _generated(spark, folder).select("p_partkey", configs.compare(c, b).alias("d"))
    return d.select("p_partkey", F.col("d.region_deltas.table_top").alias("table_top_delta"), "d.slot_delta", F.array_join("d.changed", ",").alias("changed"))


def _documents(spark, folder) -> DataFrame:
    o = load(spark, folder, "orders")
    none = F.lit(None)
    code = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return _cast_documents(o.select(F.col("o_orderkey").cast("string").alias("config_id"), code.alias("course_id"), code.alias("course_code"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 3).cast("int")).alias("version"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"), F.lit("llm").alias("generated_by"), none.alias("llm_session_id"), none.alias("config"), none.alias("rejection_reason"), F.col("o_orderdate").cast("timestamp").alias("created_at")))


def _cast_documents(df: DataFrame) -> DataFrame:
    schema = df.sparkSession.createDataFrame([], CONFIG_DOCUMENT).schema
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS config_id, 'c' || o_custkey AS course_code, 'active' AS status, 'llm' AS generated_by, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 ELSE 1 END AS INTEGER) AS version, 0e0 AS confidence, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 7""")
def configuration_list(spark, folder):
    return records.config_summaries(records.configs(_documents(spark, folder), "active", "C7"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active FROM orders")
def active_configurations(spark, folder):
    return records.active_count(_documents(spark, folder))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS config_id, 'c' || o_custkey AS course_code FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1""")
def active_configuration(spark, folder):
    return records.active_config(_documents(spark, folder), "C7").select("config_id", "course_code")


def _session_log(spark, folder) -> DataFrame:
    return _session_events(spark, _events(spark, folder))


def _session_events(spark, e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    schema = spark.createDataFrame([], SESSION_EVENT).schema
    log = e.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.when(kind == "click", F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string"))).alias("course_code"), F.when(kind == "error", "failed").when(kind == "purchase", "completed").alias("status"),
        F.when(kind == "view", "extraction").alias("phase"), F.when(kind == "view", "running").alias("phase_state"), F.when(kind == "purchase", F.col("event_id").cast("string")).alias("config_id"), F.when(kind == "purchase", F.col("value")).alias("confidence"), F.lit(None).alias("report"), F.lit(None).alias("anomalies"), F.col("ts").cast("timestamp").alias("at"),
    )
    return log.select(*(F.col(f.name).cast(f.dataType) for f in schema))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, 'C' || (user_id % 5) AS course_code, arg_max(CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END, event_id) FILTER (event_type IN ('error', 'purchase')) AS status, arg_max(value, event_id) FILTER (event_type = 'purchase') AS confidence, CAST(max(event_id) FILTER (event_type = 'purchase') AS VARCHAR) AS config_id, min(ts) AS began, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id)
SELECT session_id, course_code, coalesce(status, '') AS status, confidence, config_id, strftime(began, '%Y-%m-%d %H:%M:%S') AS created_at FROM s WHERE course_code = 'C3' AND n > 0 ORDER BY began DESC, session_id LIMIT 20""")
def recent_sessions(spark, folder):
    return calibrate.recent_sessions(_session_log(spark, folder), "C3", 20)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS q, event_type AS t, value, epoch_us(ts) AS us FROM events)
SELECT session_id, max(CASE WHEN t = 'click' THEN 'C' || (CAST(session_id AS BIGINT) % 5) END) AS course_code, arg_max(CASE t WHEN 'error' THEN 'failed' ELSE 'completed' END, q) FILTER (t IN ('error', 'purchase')) AS status, arg_max(value, q) FILTER (t = 'purchase') AS confidence,
CAST(max(q) FILTER (t = 'purchase') AS VARCHAR) AS config_id, max(CASE WHEN t = 'view' THEN 'running' END) AS extraction, min(us) AS created_us, max(us) AS updated_us, count(*) AS n_events FROM e GROUP BY 1""")
def streamed_sessions(spark, folder):
    given = load(spark, folder, "events")
    stream = spark.readStream.schema(given.schema).parquet(f"{folder}/events.parquet*")
    at = _scratch(spark)
    sessions.running(sessions.states(_session_events(spark, stream)), f"{at}/states", f"{at}/checkpoint").awaitTermination()
    out = sessions.latest(spark.read.parquet(f"{at}/states"))
    return out.select("session_id", "course_code", "status", "confidence", "config_id", F.col("phases.extraction").alias("extraction"), "created_us", "updated_us", "n_events")


# -- weeks ------------------------------------------------------------------------------------


def _results(spark, folder) -> DataFrame:
    """A result for each item: two streams of one type, the second of a group, and a repeat of the first."""
    e = lambda kind, day, start, end, label, weeks: F.struct(*((F.lit(v) if n == "week_count" else F.lit(v).cast("string")).alias(n) for n, v in (("type", kind), ("day", day), ("start_time", start), ("end_time", end), ("group_label", label), ("room", ""), ("staff", None), ("weeks", weeks), ("week_count", 0))))
    entries = F.array(e("lec", "Monday", "08:00 AM", "10:00 AM", None, "S1"), e("lab", "Tuesday", "1:00 PM", "", "L1", ""), e("lecture", "Monday", "08:00 AM", "10:00 AM", "", "S2"))
    return load(spark, folder, "part").select(F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).otherwise("").alias("course_title"), F.concat(F.col("p_brand"), F.lit(".pdf")).alias("source_file"), entries.alias("entries"))


_C = "(SELECT *, regexp_replace(regexp_replace(upper(title), '\\s+', '-', 'g'), '[^a-zA-Z0-9_-]', '', 'g') AS course_id FROM (SELECT *, CASE WHEN p_partkey % 10 <> 0 THEN p_name ELSE p_brand || '.pdf' END AS title FROM part) QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY p_partkey) = 1)"


@query(f"SELECT course_id, title, p_brand || '.pdf' AS source_file, p_partkey AS seq FROM {_C}")
def week_courses(spark, folder):
    return week.courses(_results(spark, folder)).drop("entries")


@query(f"""SELECT course_id, p_partkey AS course_seq, 0 AS seq, 'Lecture-Monday-0800 AM-1000 AM' AS stream_id, 'Lecture' AS type, 'Lecture' AS type_key, 'Monday' AS day, '08:00' AS start_time, '10:00' AS end_time, CAST(NULL AS VARCHAR) AS room, CAST(NULL AS VARCHAR) AS staff, CAST(NULL AS VARCHAR) AS group_label, 'S1' AS weeks, CAST(NULL AS INTEGER) AS week_count FROM {_C}
UNION ALL SELECT course_id, p_partkey, 1, 'Lab-Tuesday-100 PM--L1', 'Lab', 'Lab-L1', 'Tuesday', '13:00', '00:00', NULL, NULL, 'L1', NULL, NULL FROM {_C}""")
def week_streams(spark, folder):
    return week.streams(week.courses(_results(spark, folder)))


def _placements(spark, folder) -> tuple[DataFrame, DataFrame]:
    streams = week.streams(week.courses(_results(spark, folder)))
    chosen = F.when(F.col("course_seq") % 3 == 0, F.lit("gone")).otherwise(F.col("stream_id"))
    return streams.where("type = 'Lecture'").select("course_id", F.col("type").alias("stream_type"), chosen.alias("selected_stream_id")), streams


@query(f"SELECT course_id, 'Lecture' AS stream_type, 'Lecture-Monday-0800 AM-1000 AM' AS stream_id, 'Monday' AS day, '08:00' AS start_time FROM {_C} WHERE p_partkey % 3 <> 0")
def placed_events(spark, folder):
    return week.placed_events(*_placements(spark, folder)).select("course_id", "stream_type", "stream_id", "day", "start_time")


@query(f"WITH c AS MATERIALIZED (SELECT course_id, p_partkey FROM {_C}) SELECT min(course_id) AS course_id, '10:00' AS end_time FROM c WHERE p_partkey % 3 <> 0")
def placement_details(spark, folder):
    placements, streams = _placements(spark, folder)
    first = placements.where("selected_stream_id <> 'gone'").agg(F.min("course_id")).first()[0]
    return week.placement_details(placements, streams, first, "Lecture").select("course_id", "end_time")


@query(f"WITH c AS MATERIALIZED (SELECT course_id FROM {_C}) SELECT max(course_id) AS course_id, 'Lab-Tuesday-100 PM--L1' AS stream_id FROM c")
def streams_of_type(spark, folder):
    streams = week.streams(week.courses(_results(spark, folder)))
    return week.available(streams, streams.agg(F.max("course_id")).first()[0], "Lab").select("course_id", "stream_id")


_KIND = "list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type)"


@query(f"""WITH e AS (SELECT user_id, event_id, event_id % 3 AS course, {_KIND} AS rank, dayname(ts) AS d, minute AS s, least(minute + 120, 1439) AS e FROM {E}),
s AS (SELECT user_id, course, rank, list(struct_pack(q := event_id, d := d, s := s, e := e) ORDER BY event_id) AS c FROM e GROUP BY 1, 2, 3),
g AS (SELECT user_id, list(struct_pack(course := course, rank := rank, c := c) ORDER BY course, rank) AS l, count(*) AS n FROM s GROUP BY 1),
w AS (WITH RECURSIVE w AS (SELECT user_id, l, n, 1 AS k, CAST([] AS STRUCT(q BIGINT, d VARCHAR, s INTEGER, e INTEGER)[]) AS acc FROM g
  UNION ALL SELECT user_id, l, n, k + 1, list_append(acc, list_filter(l[k].c, lambda x: x.q = b.q)[1]) FROM (
    SELECT *, list_min(list_transform(l[k].c, lambda x: struct_pack(o := len(list_filter(acc, lambda p: p.d = x.d AND p.s < x.e AND x.s < p.e)), q := x.q))) AS b FROM w WHERE k <= n)) SELECT * FROM w WHERE k = n + 1)
SELECT user_id, CAST(i - 1 AS INTEGER) AS seq, 'C' || l[i].course AS course_id, ['Lecture', 'Lab', 'Tutorial', 'Seminar', 'Workshop'][l[i].rank] AS stream_type, CAST(acc[i].q AS VARCHAR) AS selected_stream_id FROM (SELECT user_id, l, acc, unnest(range(1, len(acc) + 1)) AS i FROM w)""")
def week_place(spark, folder):
    kinds = dict(zip(("click", "view", "purchase", "signup", "error"), week.TYPE_ORDER))
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()))
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60), m % 60)
    e = _events(spark, folder)
    streams = e.select("user_id", F.concat(F.lit("C"), (F.col("event_id") % 3).cast("string")).alias("course_id"), (F.col("event_id") % 3).alias("course_seq"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("stream_id"), kind.alias("type"), F.date_format("ts", "EEEE").alias("day"), clock(F.col("minute")).alias("start_time"), clock(F.least(F.col("minute") + 120, F.lit(1439))).alias("end_time"))
    return week.place(streams, ["user_id"])


_A = "CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' WHEN 'purchase' THEN 'remove' ELSE 'move' END"
#: Each user's log replayed event by event: done edits (the last 50 can be undone), undone ones, and how many undo can take.
_REPLAY = f"""l AS (SELECT user_id, list(struct_pack(q := event_id, a := {_A}, k := minute % 5) ORDER BY event_id) AS l, count(*) AS n FROM {E} GROUP BY 1),
w AS (WITH RECURSIVE w AS (SELECT user_id, l, n, 1 AS i, CAST([] AS STRUCT(q BIGINT, a VARCHAR, k INTEGER)[]) AS done, CAST([] AS STRUCT(q BIGINT, a VARCHAR, k INTEGER)[]) AS undone, 0 AS depth FROM l
  UNION ALL SELECT user_id, l, n, i + 1,
    CASE a WHEN 'undo' THEN CASE WHEN depth > 0 THEN done[:-2] ELSE done END WHEN 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END ELSE CASE WHEN edit THEN list_append(done, l[i]) ELSE done END END,
    CASE a WHEN 'undo' THEN CASE WHEN depth > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN 'redo' THEN undone[:-2] ELSE CASE WHEN edit THEN [] ELSE undone END END,
    CASE a WHEN 'undo' THEN greatest(depth - 1, 0) WHEN 'redo' THEN CASE WHEN len(undone) > 0 THEN depth + 1 ELSE depth END ELSE CASE WHEN edit THEN least(depth + 1, 50) ELSE depth END END
    FROM (SELECT *, l[i].a AS a, l[i].a = 'move' OR coalesce(list_filter(done, lambda x: x.k = l[i].k)[-1].a, '') = 'move' AS edit FROM w WHERE i <= n)) SELECT * FROM w WHERE i = n + 1)"""


def _edit_log(spark, folder) -> DataFrame:
    """A log for each user: clicks and views move one of five placements, purchases remove one, often one that is not there."""
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").when(F.col("event_type") == "purchase", "remove").otherwise("move")
    return _events(spark, folder).select("user_id", F.col("event_id").alias("seq"), action.alias("action"), F.lit("c").alias("course_id"), (F.col("minute") % 5).alias("stream_type"))


@query(f"WITH {_REPLAY} SELECT user_id, unnest(done).q AS seq FROM w")
def edits_in_force(spark, folder):
    return week.edits_in_force(_edit_log(spark, folder), ["user_id"], block_rows=64).select("user_id", "seq")


@query(f"WITH {_REPLAY}, u AS (SELECT user_id, list_reverse(done[len(done) - depth + 1:]) AS u FROM w) SELECT user_id, CAST(i - 1 AS INTEGER) AS place, u[i].q AS seq FROM (SELECT user_id, u, unnest(range(1, len(u) + 1)) AS i FROM u)")
def undo_points(spark, folder):
    return week.undo_points(_edit_log(spark, folder), ["user_id"], block_rows=64)


@query(f"""WITH m AS (SELECT user_id, CAST(minute % 7 AS VARCHAR) AS stream_type, arg_max(CASE WHEN event_type <> 'login' THEN event_type END, event_id) AS x, max(event_id) AS q, max(event_id) FILTER (event_type <> 'login') AS p FROM {E} GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS course_id, stream_type, x AS selected_stream_id FROM m WHERE p = q""")
def placements_of_log(spark, folder):
    action = F.when(F.col("event_type") == "login", "remove").otherwise("move")
    log = _events(spark, folder).select(F.col("event_id").alias("seq"), action.alias("action"), F.col("user_id").cast("string").alias("course_id"), (F.col("minute") % 7).cast("string").alias("stream_type"), F.when(action == "move", F.col("event_type")).alias("selected_stream_id"))
    return week.placements_at(log)


# -- scalars, sources and sinks ---------------------------------------------------------------


@query("""SELECT o_orderkey, ['00:00', '09:05', '21:05', '08:00'][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS stored, ['monday', 'thursday', 'wednesday', NULL][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS weekday, ['', '09:05', '09:05', 'NOON'][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS bare, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '_None_' END AS marked,
'&lt;b&gt;' || o_orderpriority || ' &amp; &quot;x&#39;&quot;&lt;/b&gt;' AS escaped, o_orderkey % 3 < 2 AS semester, CASE WHEN o_orderkey % 2 = 0 THEN 'a|b c' ELSE '' END AS listed FROM orders""")
def scalar_texts(spark, folder):
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    at = pick("", "9:05 am", "09:05PM", "8:00 am")
    return load(spark, folder, "orders").select(
        "o_orderkey", times.stored_time(at).alias("stored"), keys.weekday(pick("Mon", " thurs ", "Weds", "someday")).alias("weekday"), times.bare_time(pick("", "09:05 am", "09:05PM", "noon")).alias("bare"), text.or_none_mark(F.when(k % 2 == 0, F.col("o_custkey"))).alias("marked"),
        text.escape_html(F.concat(F.lit("<b>"), F.col("o_orderpriority"), F.lit(" & \"x'\"</b>"))).alias("escaped"), text.is_semester(pick("Semester_1", "Summer_2", "Term_3")).alias("semester"), F.array_join(text.list_argument(pick("a, ,b c,", " , ")), "|").alias("listed"),
    )


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'module' ELSE '' END AS type, '' AS link, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS dept, '' AS faculty FROM part""")
def xml_resources(spark, folder):
    k = F.col("p_partkey")
    x = F.concat(F.lit('<resource id="'), k.cast("string"), F.when(k % 2 == 0, F.lit('" type="module">')).otherwise(F.lit('">')), F.when(k % 5 == 0, F.concat(F.lit("<name>"), "p_name", F.lit("</name>"))).otherwise(F.concat(F.lit("<n> "), "p_name", F.lit(" </n>"))), F.when(k % 3 == 0, F.concat(F.lit("<dept>"), "p_brand", F.lit("</dept>"))).otherwise(F.lit("")), F.lit("</resource>"))
    return resources.parse(load(spark, folder, "part").select(x.alias("x")), "x")


@query("""SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice * l_discount / 7) AS DOUBLE) AS two, CAST(printf('%.2f', l_quantity / 8e0) AS DOUBLE) AS eighths, CAST(printf('%.4f', l_extendedprice / 3e0) AS DOUBLE) AS four, CAST(printf('%.1f', -l_quantity / 4e0) AS DOUBLE) AS below FROM lineitem""")
def rounded_measures(spark, folder):
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", exact_round(price * F.col("l_discount").cast("double") / 7, 2).alias("two"), exact_round(quantity / 8, 2).alias("eighths"), exact_round(price / 3, 4).alias("four"), exact_round(-quantity / 4, 1).alias("below"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'module' ELSE '' END AS type, '/r/' || p_partkey AS link, p_name || ' & more' AS name, p_brand AS dept, CASE WHEN p_partkey % 3 = 0 THEN '<' || p_type || '>' ELSE '' END AS faculty FROM part""")
def xml_files(spark, folder):
    """Index files of many resources, read by the element of a row."""
    k = F.col("p_partkey").cast("string")
    x = F.concat(F.lit('<resource id="'), k, F.when(F.col("p_partkey") % 2 == 0, F.lit('" type="module"')).otherwise(F.lit('"')), F.lit(' link="/r/'), k, F.lit('">\n  <name> '), text.escape_html(F.concat("p_name", F.lit(" & more"))), F.lit(" </name><dept>"), "p_brand", F.lit("</dept>"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<faculty>&lt;"), "p_type", F.lit("&gt;</faculty>"))).otherwise(F.lit("<other/>")), F.lit("</resource>"))
    path = _scratch(spark)
    whole = F.concat(F.lit("<resources>"), F.array_join(F.collect_list(x), "\n"), F.lit("</resources>"))
    load(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(whole.alias("value")).write.partitionBy("file").text(path)
    return resources.read(spark, path)


@query("""WITH b AS (SELECT p_partkey AS k, 'w' || (p_partkey // 4) AS file, CAST(p_partkey % 4 + 1 AS INTEGER) AS page FROM part)
SELECT file, page, 0 AS cluster_idx, 250e0 AS y_top, 1 AS n_words FROM b WHERE k % 3 > 0 UNION ALL SELECT file, page, 2, 250e0, CASE k % 3 WHEN 1 THEN 1 ELSE 2 END FROM b WHERE k % 3 > 0""")
def words_of_two_blocks(spark, folder):
    """Two boxes over one word, which is in both blocks; on some pages a second word is in one only, on others there is none, and so no block; a third box never has words."""
    k = F.col("p_partkey")
    p = load(spark, folder, "part").select(k, F.concat(F.lit("w"), F.floor(k / 4).cast("string")).alias("file"), (k % 4 + 1).cast("int").alias("page"))
    word = lambda t, x, top: F.struct(F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(x + 20).alias("x1"), F.lit(top).alias("top"), F.lit(top + 8).alias("bottom"))
    box = lambda x0, x1, top: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(top).alias("top"), F.lit(top + 10).alias("bottom"), F.lit(x1 - x0).alias("width"), F.lit(True).alias("fill"))
    words = _cast(_rows(p, ["file", "page"], [F.when(k % 3 > 0, word("both", 120.0, 250.0)), F.when(k % 3 == 2, word("one", 192.0, 260.0)), word("far", 700.0, 20.0)]), WORDS)
    rects = _cast(_rows(p, ["file", "page"], [box(100.0, 200.0, 150.0), box(115.0, 230.0, 200.0), box(400.0, 500.0, 150.0)]), RECTS)
    limits = layout.with_limits(_cast(p.select("file", "page", F.lit(800.0).alias("width"), F.lit(600.0).alias("height")), PAGES))
    return layout.blocks(words, layout.boxes(rects, limits), limits).select("file", "page", "cluster_idx", "y_top", F.size("words").alias("n_words"))


def _outline(content: bytes) -> Iterator[dict]:
    """A page's list items as words and its paragraphs as boxes, two paragraphs a page; a page that breaks off cannot be read to its end."""
    html = content.decode()
    items, paragraphs = html.count("<li>"), html.count("<p>")
    for k in range(0, paragraphs, 2):
        words = [{"text": f"item{i}", "x0": 10.0 * i, "x1": 10.0 * i + 8, "top": 1.0, "bottom": 2.0} for i in range(items if k == 0 else 0)]
        boxes = [{"x0": 0.0, "x1": 90.0, "top": 10.0 * i, "bottom": 10.0 * i + 5, "width": 90.0, "fill": i == 0} for i in range(min(2, paragraphs - k))]
        yield {"width": 100.0, "height": 50.0, "words": words, "rects": boxes}
    if "</html>" not in html:
        raise ValueError("breaks off")


_COUNT = "CAST((length(html) - length(replace(html, '{0}', ''))) / {1} AS INTEGER)"


@query(f"""WITH p AS (SELECT 'p' || page_id || '.html' AS file, {_COUNT.format('<li>', 4)} AS items, {_COUNT.format('<p>', 3)} AS paragraphs, NOT contains(html, '</html>') AS broken FROM pages)
SELECT file, CAST((paragraphs + 1) // 2 AS INTEGER) AS pages, CASE WHEN paragraphs > 0 THEN items ELSE 0 END AS words, paragraphs AS rects, CAST((paragraphs + 1) // 2 AS INTEGER) AS filled, CASE WHEN broken THEN 'ValueError: breaks off' END AS error FROM p WHERE paragraphs > 0 OR broken""")
def decoded_documents(spark, folder):
    docs = load(spark, folder, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").cast("binary").alias("content"))
    words, rects, pages, errors = pages_source.decode(docs, _outline)
    count = lambda df, name: df.groupBy("file").agg(F.count("*").alias(name))
    out = pages.select("file").unionAll(errors.select("file")).distinct()
    for df in (count(pages, "pages"), count(words, "words"), count(rects, "rects"), count(rects.where("fill"), "filled"), errors.select("file", "error")):
        out = out.join(df, "file", "left")
    return out.select("file", *(F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in ("pages", "words", "rects", "filled")), "error")


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_nationkey || '; ' || c_mktsegment AS tags FROM customer")
def csv_round_trip(spark, folder):
    path = _scratch(spark)
    files.csv(load(spark, folder, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("tags")), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def json_round_trip(spark, folder):
    path = _scratch(spark)
    files.json_lines(load(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"), path, partition="c_nationkey")
    return spark.read.schema("c_custkey long, c_name string, c_nationkey int").json(path)


@query("SELECT c_acctbal, c_custkey, c_name, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nation FROM customer")
def json_array_in_order(spark, folder):
    path = _scratch(spark).removeprefix("file:")
    ranked = load(spark, folder, "customer").select("c_acctbal", "c_custkey", "c_name", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"))
    files.json_array(ranked, path, [F.desc("c_acctbal"), "c_custkey"])
    return files.read_json_array(spark, path, "c_acctbal double, c_custkey long, c_name string, nation int")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def shown_rows(spark, folder):
    return files.shown(load(spark, folder, "nation").orderBy("n_nationkey"), ["n_nationkey", "absent", "n_name"], 10)
