"""Scalar functions against golden and derived cases."""

import pytest
from pyspark.sql import functions as F

from chronogrid.functions import keys, text, times


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, compare, ui", [("05:00 PM", 1020, 1020), ("01:00PM", 780, 780), ("12:00 AM", 0, 0), ("12:00 PM", 720, 720), ("17:30", 1050, 1050), ("", 0, 480), ("noon", 0, 0), (None, 0, 480), ("1:2:3", 0, 0)])
def test_minutes(spark, raw, compare, ui):
    assert one(spark, raw, times.minutes) == compare
    assert one(spark, raw, times.minutes_ui) == ui


def test_time_texts(spark):
    assert one(spark, "8:00am", times.display_time) == "08:00 AM"
    assert one(spark, " soon ", times.display_time) == "soon"
    assert one(spark, "09:05 PM", times.stored_time) == "21:05"
    assert one(spark, None, times.stored_time) == "00:00"
    assert one(spark, "22:00", times.grid_slot) == 28
    assert one(spark, "07:59", times.grid_slot) == -1
    assert one(spark, "0", lambda c: times.clock_label(c.cast("int"))) == "12:00 AM"
    assert one(spark, " 02:00 pm", times.bare_time) == "02:00"


GOLDEN = "Postgraduate, Wks SUM W1-SUM W6\n[=6]\nCourse: RENT 6008\nStaff: POWELL,Courtney\nRoom: Remote Teaching"


@pytest.mark.parametrize(
    "block, want",
    [
        (GOLDEN, ("Postgraduate", "SUM W1-SUM W6", 6, "RENT 6008", "POWELL,Courtney", "Remote Teaching", None)),
        ("Lecture, Wks S2W7- S2W12 [=6] Course: COMP 2603 (L1) Staff: MATHURIN,Sergio Room: FST CSL1 W", ("Lecture", "S2W7-S2W12", 6, "COMP 2603", "MATHURIN,Sergio", "FST CSL1", "L1")),
        ("Course: A Room: X1 Room: ENG 10 [=2]", (None, None, 2, "A", None, "ENG 10", None)),
        ("Course: A Room: ", (None, None, None, "A", None, None, None)),
        ("Staff: A Rooms: B", (None, None, None, None, "A Rooms: B", None, None)),
        ("", (None,) * 7),
    ],
)
def test_parse_block(spark, block, want):
    p = one(spark, block, text.parse_block)
    assert (p.type, p.weeks, p.week_count, p.course, p.staff, p.room, p.group_label) == want


def test_fields_over_several_lines(spark):
    t = "Lab, S2W7-\nS2W12 SUMW1-SUMW2 [=6]\nCourse: COMP\n2603\nStaff: A,\nB\nRoom: FST\nCSL1\nW"
    p = one(spark, t, text.parse_block)
    assert (p.weeks, p.course, p.staff, p.room, p.raw_text) == ("S2W7-S2W12", "COMP 2603", "A, B", "FST CSL1", t)
    assert one(spark, "SUMW1-SUMW2", text.weeks) is None and one(spark, "SUM W1-SUM W2", text.weeks) == "SUM W1-SUM W2"


def test_listed_types_come_in_list_order(spark):
    assert one(spark, "Lab and Lecture (C+)", lambda c: text.activity_type(c, F.array(F.lit("Studio"), F.lit("Lab"), F.lit("Lecture")))) == "Lab"
    assert one(spark, "Lab and Lecture", lambda c: text.activity_type(c, F.array().cast("array<string>"))) == "Lecture"


def test_block_text_lines(spark):
    words = [(10.4, 5.0, 1, "b"), (9.6, 1.0, 0, "a"), (20.0, 1.0, 2, "c")]
    df = spark.createDataFrame([(words,)], "w array<struct<top:double,x0:double,seq:int,text:string>>")
    assert df.select(text.block_text(F.col("w")).alias("r")).first().r == "a b\nc"


def test_keys(spark):
    assert [one(spark, x, keys.activity) for x in ("lec", " LAB ", "Postgraduate")] == ["Lecture", "Lab", "Other"]
    assert [one(spark, x, keys.weekday) for x in ("Tues", "weds", "Thurs", "Mondays", "x")] == ["tuesday", "wednesday", "thursday", "monday", None]
    assert [one(spark, x, keys.day_of_label) for x in ("yadsendeW", "eW", "nope")] == ["Wednesday", "Wednesday", None]
    assert one(spark, "Comp 1 (a)", keys.course_slug) == "COMP-1-A"
    assert one(spark, "L1", lambda c: keys.stream_id(F.lit("lab"), F.lit("Monday"), F.lit("08:00 AM"), F.lit("10:00 AM"), c)) == "Lab-Monday-0800 AM-1000 AM-L1"


def test_json_and_edges(spark):
    for reply in ('```json\n{"k": 1}\n```', 'Sure: {"k": 1} done', '{"k": 1}'):
        assert one(spark, reply, lambda c: text.parse_json(c, "k int")["k"]) == 1
    assert one(spark, "nothing", lambda c: text.parse_json(c, "k int")["k"]) is None
    assert one(spark, "<a&'\">", text.escape_html) == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, "x" * 31, text.shortened) == "x" * 28 + ".."
    assert one(spark, None, text.or_none_mark) == "_None_"
    assert one(spark, "a, ,b", text.list_argument) == ["a", "b"]


def test_exact_round_is_that_of_the_double(spark):
    import math
    import random

    from chronogrid.functions.numbers import exact_round

    rng = random.Random(1)
    kinds = [lambda: rng.uniform(-1000, 1000), lambda: rng.randrange(10**6) / 1000 + 0.005, lambda: rng.randrange(-(10**7), 10**7) / 1000, lambda: rng.randrange(1000) / 8, lambda: rng.uniform(0, 1) * 10 ** rng.randint(-8, 15), lambda: rng.randrange(10**8) / 10**5]
    values = [rng.choice(kinds)() for _ in range(60_000)] + [2.675, 1.005, 0.125, 0.375, -2.675, 0.0, 1e300, 5e-324, 4503599627370497.5, 1e13 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 4):
        assert [r[0] for r in df.select(exact_round(F.col("x"), places)).collect()] == [round(v, places) for v in values]
    odd = spark.createDataFrame([(None,), (math.inf,), (math.nan,)], "x double").select(exact_round(F.col("x"), 2).alias("x")).collect()
    assert odd[0].x is None and odd[1].x == math.inf and math.isnan(odd[2].x)


def test_block_is_cut_at_its_labels_once(spark):
    df = spark.createDataFrame([("Lab Course: a Staff: b Room: c 1 Course:  Wks 3 Staff: Doe, J (L2) x",), ("",), (None,)], "t string")
    made = df.select(text.parse_block(F.col("t")).alias("p"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count(r"-\s+(S") == 1
    assert [(r.p.type, r.p.course, r.p.staff, r.p.room, r.p.group_label) for r in made.collect()] == [("Lab", None, "Doe, J", "c", "L2"), (None,) * 5, (None,) * 5]
