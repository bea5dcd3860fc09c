"""Whole plans over synthetic pages and entries, sources, sinks and a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import records
from chronogrid.plans import audit, calibrate, compare, extract, week
from chronogrid.schemas import PAGES, RECTS, WORDS
from chronogrid.sinks import files, reports
from chronogrid.sources import pages as sources
from chronogrid.sources import providers, resources, state
from chronogrid.streaming import landing


def page(spark):
    w = [("Semester_1", 70, 20), ("Course", 70, 40), ("timetable", 100, 41), ("COMP", 150, 42), ("08:00AM", 100, 100), ("09:00AM", 200, 100), ("10:00AM", 300, 100), ("yadnoM", 30, 150), ("yadsendeW", 30, 300)]
    w += [("Lecture,", 105, 152), ("Wks", 150, 152), ("S1W1-S1W12", 110, 162), ("[=12]", 160, 162), ("Course:", 105, 172), ("COMP", 130, 172), ("1600", 150, 172), ("Room:", 105, 182), ("FST", 130, 182), ("Lab,", 205, 302), ("Course:", 205, 312), ("COMP", 230, 312), ("1601", 250, 312)]
    words = [("a.pdf", 1, i, t, float(x), float(x + 20), float(y), float(y + 8)) for i, (t, x, y) in enumerate(w)]
    rects = [("a.pdf", 1, 0, 100.0, 200.0, 150.0, 160.0, 100.0, True), ("a.pdf", 1, 1, 200.0, 300.0, 300.0, 310.0, 100.0, True), ("a.pdf", 1, 2, 100.0, 200.0, 400.0, 410.0, 100.0, False)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(rects, RECTS), spark.createDataFrame([("a.pdf", 1, 800.0, 600.0)], PAGES)


def test_extract(spark):
    words, rects, pages = page(spark)
    r = extract.results(words.repartition(3), rects, pages).collect()
    assert len(r) == 1 and r[0].semester == "Semester_1" and r[0].course_title == "Course timetable COMP"
    got = [(e.day, e.start_time, e.end_time, e.type, e.weeks, e.week_count, e.course, e.room) for e in r[0].entries]
    assert got == [("Monday", "08:00 AM", "09:00 AM", "Lecture", "S1W1-S1W12", 12, "COMP 1600", "FST"), ("Wednesday", "09:00 AM", "10:00 AM", "Lab", None, None, "COMP 1601", None)]


def test_extraction_broadcasts_no_table(spark):
    """Pages and words grow with the input, and stay small by their file: no join of an extraction may send them through the driver."""
    words, rects, pages = tables = [df.cache() for df in page(spark)]
    assert all(df.count() for df in tables)  # their sizes are known now
    got = [extract.results(words, rects, pages), extract.entries(words, rects, pages), audit.run(words, pages)["missing"]]
    for df in got:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_audit_and_reports(spark, tmp_path):
    words, _, pages = page(spark)
    out = audit.run(words, pages)
    assert out["headers"].count() == 3 and len(out["missing"].first().missing) == 11 and out["verdict"].first().issues == 1
    assert "1 issues" in reports.audit_text(out)
    files.audit_csv(out, str(tmp_path / "csv"))
    assert "; " in spark.read.option("header", True).csv(str(tmp_path / "csv/missing")).first().missing


def test_compare(spark):
    rule = spark.createDataFrame([("m", 0, "Monday", "01:00 PM", "02:00 PM", "R1 ", "A, B", "Lecture", "C", None, None, None), ("m", 1, "Friday", "08:00 AM", "09:00 AM", None, None, "Lab", "C", None, None, None)], "pdf string, idx int, day string, start_time string, end_time string, room string, staff string, type string, course string, weeks string, week_count int, group_label string")
    llm = spark.createDataFrame([("m", 0, "Monday", "01:00PM", "02:00PM", "r1", "AB", "Lecture")], "pdf string, idx int, day string, start_time string, end_time string, room string, staff string, activity_type string")
    a, b = records.normalise(rule, "rule"), records.normalise(llm, "llm")
    out = compare.run(a, b)
    p = out["per_file"].first()
    assert (p.rule_count, p.llm_count, p.matched_count, p.only_rule_count, p.match_rate) == (2, 1, 1, 1, 0.5)
    assert set(out["disagreements"].first().differences) == {"start_time", "end_time"}
    assert compare.run(a, b, times_as_minutes=True)["disagreements"].count() == 0
    assert out["only_rule"].first().day == "Friday" and out["overall"].first().rule_mean_duration == 60.0
    assert "| m | 2 | 1 | 1 | 50.0% |" in reports.comparison(out)


def test_reports_say_what_they_leave_out(spark):
    files_ = spark.range(1203).selectExpr("format_string('f%05d', id) AS pdf", "1 AS rule_count", "1 AS llm_count", "0 AS matched_count", "0D AS match_rate")
    overall = spark.sql("SELECT 1203 AS rule_count, 1203 AS llm_count, 0 AS matched_count, 0 AS only_rule_count, 0 AS only_llm_count, 1105 AS disagreement_count, 1D AS rule_mean_duration, 1D AS llm_mean_duration")
    differing = spark.range(1105).selectExpr("'f' AS pdf", "'Mon' AS day", "'a' AS rule_start", "'b' AS llm_start", "map('room', array('x', 'y')) AS differences")
    text = reports.comparison({"overall": overall, "per_file": files_, "disagreements": differing})
    assert "Compared: 1203;" in text and "\n203 more rows left out." in text and "\n105 more rows left out." in text
    assert "left out" not in reports.comparison({"overall": overall, "per_file": files_, "disagreements": differing}, most=1203)
    summary = spark.sql("SELECT 'l' AS label, 1D AS median, 1D AS least, 1D AS greatest, 0D AS deviation, 1 AS n, 's' AS status")
    off = spark.range(57).selectExpr("'f' AS file", "1 AS page", "'l' AS label", "1D AS expected_x", "2D AS actual_x", "1D AS delta")
    missing = spark.range(61).selectExpr("'f' AS file", "1 AS page", "array('l') AS missing")
    text = reports.audit_text({"summary": summary, "discrepancies": off, "missing": missing, "verdict": spark.sql("SELECT 118 AS issues")})
    assert "\n7 more rows left out." in text and "\n11 more rows left out." in text


def test_week(spark):
    e = lambda kind, day, s, t: {"type": kind, "day": day, "start_time": s, "end_time": t, "group_label": None, "room": None, "staff": "", "weeks": None, "week_count": 0}
    rows = [(0, "Comp 1", "a.pdf", [e("lec", "Mon", "08:00 AM", "10:00 AM"), e("lab", "Mon", "09:00 AM", "11:00 AM"), e("lab", "Tue", "09:00 AM", "11:00 AM")]), (1, "", "b.pdf", [e("lec", "Mon", "09:00 AM", "10:00 AM")]), (2, "comp  1", "c.pdf", [])]
    kind = "array<struct<type:string,day:string,start_time:string,end_time:string,group_label:string,room:string,staff:string,weeks:string,week_count:int>>"
    courses = week.courses(spark.createDataFrame(rows, f"seq int, course_title string, source_file string, entries {kind}"))
    assert sorted(r.course_id for r in courses.collect()) == ["BPDF", "COMP-1"]
    streams = week.streams(courses).withColumn("plan", F.lit("p"))
    placed = week.place(streams, ["plan"])
    assert [r.selected_stream_id for r in placed.orderBy("seq").collect()] == ["Lecture-Mon-0800 AM-1000 AM", "Lab-Tue-0900 AM-1100 AM", "Lecture-Mon-0900 AM-1000 AM"]
    events = week.placed_events(placed, streams, ["plan"])
    assert week.find_conflicts(events).count() == 1
    assert week.placement_details(placed.drop("plan"), streams, "COMP-1", "Lab").first().start_time == "09:00"
    log = spark.createDataFrame([(1, "move", "A", "Lab", "x"), (2, "move", "A", "Lab", "y"), (3, "remove", "A", "Lab", None)], "seq int, action string, course_id string, stream_type string, selected_stream_id string")
    assert week.placements_at(log).count() == 0 and week.placements_at(log, 2).first().selected_stream_id == "y"


def test_decoder_keeps_pages_before_an_error(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"other")

    def decoder(content):
        yield {"width": 1.0, "height": 2.0, "words": [{"text": "x", "x0": 1.0, "x1": 2.0, "top": 3.0, "bottom": 4.0}], "rects": []}
        if content == b"bad":
            raise ValueError("broken")

    words, _, pages, errors = sources.decode(sources.documents(spark, str(tmp_path)), decoder)
    assert words.count() == 2 and pages.count() == 2 and errors.first().error == "ValueError: broken"


def test_resources(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<all><resource id="1" type="module" link="l"><n> A </n><dept>D</dept></resource><resource id="2"><name>B</name></resource></all>')
    rows = resources.read(spark, str(tmp_path / "r.xml")).orderBy("id").collect()
    assert [(r.name, r.dept, r.faculty, r.type) for r in rows] == [("A", "D", "", "module"), ("B", "", "", "")]


def mock():
    """A provider made here, so that it travels to the workers by value."""

    class Mock:
        name, model = "mock", "m"

        def extract_timetable(self, content):
            if content == b"bad":
                raise RuntimeError("no reply")
            return '```json\n{"entries": [{"day": "Mon", "start_time": "08:00 AM", "end_time": "09:00 AM"}]}\n```'

        def generate_config(self, content, extraction):
            return '{"confidence": 0.95, "layout_signature": "v1"}'

    return Mock()


def test_calibration(spark, tmp_path):
    assert isinstance(mock(), providers.Provider)
    docs = spark.createDataFrame([("a.pdf", bytearray(b"ok"))], "file string, content binary")
    run = calibrate.Calibration(spark, str(tmp_path), mock(), report=reports.patterns)
    session_id = run.run(docs, "comp1")
    s = calibrate.sessions(state.read(spark, str(tmp_path), "session_events")).first()
    assert (s.session_id, s.status, s.confidence, s.phases["report"]) == (session_id, "completed", 0.95, "completed")
    c = state.read(spark, str(tmp_path), "course_configs").first()
    assert (c.course_code, c.version, c.status, c.config.layout_signature) == ("COMP1", 1, "draft", "v1")
    assert records.active_config(records.activate(state.read(spark, str(tmp_path), "course_configs"), c.config_id), "comp1").count() == 1
    try:
        run.run(docs.withColumn("content", F.lit("bad").cast("binary")), "comp1")
        raise AssertionError("must fail")
    except RuntimeError:
        pass
    assert {r.status for r in calibrate.sessions(state.read(spark, str(tmp_path), "session_events")).collect()} == {"completed", "failed"}


def test_json_sink_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "rows.json")
    many = spark.range(500).selectExpr("id AS k", "if(id % 7 = 0, null, concat('v\"', id, '\\n')) AS v").repartition(6)
    files.json_array(many, path, [F.desc("k")])
    assert json.loads(open(path).read()) == [{"k": k, "v": f'v"{k}\n' if k % 7 else None} for k in range(499, -1, -1)]
    assert files.read_json_array(spark, path, "k long, v string").exceptAll(many).count() == 0
    files.json_array(df.where("k > 5"), path, ["k"])
    assert json.loads(open(path).read()) == []
    files.json_array(df, path, ["k"])
    assert json.loads(open(path).read()) == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}] and [p.name for p in tmp_path.iterdir()] == ["rows.json"]
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS label, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'x', 3.0D UNION ALL SELECT timestamp'2024-01-01 03:00:00', 'x', 5.0D").write.parquet(src)
    stream = landing.windowed_labels(landing.read(spark, src, "ts timestamp, label string, v double"), "ts", "label", "v")
    got = []
    q = landing.each_batch(stream, str(tmp_path / "cp"), lambda b, _: got.extend(b.collect()))
    q.awaitTermination()
    assert [(r.n, r.least, r.greatest) for r in got] == [(2, 1.0, 3.0)]


def replayed(events, most=50):
    """Plain replay with snapshots of (placements, edits in force) before each edit: edits in force, and those undo can take."""
    placed, done, past, future = {}, [], [], []
    for seq, action, key, named in events:
        if action == "undo":
            if past:
                future.append((dict(placed), list(done)))
                placed, done = past.pop()
        elif action == "redo":
            if future:
                past.append((dict(placed), list(done)))
                placed, done = future.pop()
        elif action != "remove" or key in placed:
            past = [*past, (dict(placed), list(done))][-most:]
            future = []
            done = [*done, seq]
            if action == "move":
                placed[key] = seq
            elif action == "remove":
                del placed[key]
            else:
                placed = dict.fromkeys(named)
    return set(done), [s for s in reversed(done)][: len(past)]


LOG = "plan string, seq int, action string, course_id string, stream_type string, placed array<string>"


def edits(spark, rows, **more):
    log = spark.createDataFrame(rows, LOG).repartition(3)
    kept, points = {}, {}
    for r in week.edits_in_force(log, ["plan"], **more).collect():
        kept.setdefault(r.plan, set()).add(r.seq)
    for r in week.undo_points(log, ["plan"], **more).orderBy("place").collect():
        points.setdefault(r.plan, []).append(r.seq)
    return kept, points


def test_undo_and_redo(spark):
    rows = [("p", i, a, "c", "Lab", None) for i, a in enumerate("move move undo redo undo undo undo redo move redo remove".split())] + [("q", 0, "undo", None, None, None), ("r", 0, "move", "c", "Lab", None)]
    rows += [("s", i, "move", "c", "Lab", None) for i in range(60)] + [("s", 60 + i, "undo", None, None, None) for i in range(70)]
    rows += [(None, 0, "move", "a", "Lab", None), (None, 1, "remove", "b", "Lab", None), (None, 2, "undo", None, None, None)]
    assert edits(spark, rows)[0] == {"p": {0, 8, 10}, "r": {0}, "s": set(range(10))}  # the removal of what is not there is no edit, so undo takes the move


@pytest.mark.parametrize("block_rows", [37, 400, 100_000])
def test_long_logs_in_blocks(spark, block_rows):
    rng = random.Random(4)
    rows, want = [], {}
    for plan, n, undos in (("long", 10_000, 0.3), ("undone", 1500, 0.6), ("short", 12, 0.3), ("moves", 400, 0.0)):
        log = []
        for seq in range(n):
            action = rng.choices(("undo", "redo", "move", "remove", "auto"), (undos, 0.15, 0.3, 0.3, 0.01))[0]
            key = (rng.choice("abc"), rng.choice(("Lab", "Lecture", "Rare")) if rng.random() < 0.98 else f"Once{seq}")
            log.append((seq, action, key, [json.dumps(["a", "Lab"], separators=(",", ":")), json.dumps(["b", "Rare"], separators=(",", ":"))] if action == "auto" else None))
        rows += [(plan, seq, action, *key, named) for seq, action, key, named in log]
        want[plan] = replayed([(seq, action, json.dumps(key, separators=(",", ":")), named) for seq, action, key, named in log])
    kept, points = edits(spark, rows, block_rows=block_rows)
    assert kept == {p: w[0] for p, w in want.items()}
    assert points == {p: w[1] for p, w in want.items() if w[1]}


def test_undo_after_a_removal_of_nothing_and_an_empty_log(spark):
    rows = [("p", 0, "move", "a", "Lab", None), ("p", 1, "remove", "b", "Lab", None), ("p", 2, "undo", None, None, None)]
    assert edits(spark, rows) == ({}, {})
    assert edits(spark, []) == ({}, {})


def test_audit_leaves_failed_files_out(spark):
    label = lambda file, page, x: (file, page, 0, "08:00AM", x, x + 5, 100.0, 110.0)
    words = spark.createDataFrame([label("a", 1, 10.0), label("b", 1, 10.0), label("c", 1, 50.0)], WORDS)
    pages = spark.createDataFrame([(f, 1, 1.0, 1.0) for f in "abc"], "file string, page int, width double, height double")
    errors = spark.createDataFrame([("c", "cannot be read")], "file string, error string")
    found = audit.run(words, pages, errors)
    assert found["discrepancies"].count() == 0 and {r.file for r in found["missing"].collect()} == {"a", "b"}
    assert found["verdict"].first().issues == 3 and audit.run(words, pages)["verdict"].first().issues == 4


def test_sessions_of_a_course(spark):
    import datetime as dt

    rows = [(f"s{i}", 1, f"C{i % 2}", "completed", None, None, None, 0.5, None, None, dt.datetime(2024, 1, 1 + i)) for i in range(6)]
    from chronogrid.schemas import SESSION_EVENT

    log = spark.createDataFrame(rows, SESSION_EVENT)
    assert [r.session_id for r in calibrate.recent_sessions(log, "C1", 2).collect()] == ["s5", "s3"]
    assert calibrate.recent_sessions(log, "c1").count() == 0 and calibrate.recent_sessions(log).count() == 6


def test_configuration_limits_need_both_edges(spark):
    from chronogrid.operators import layout
    from chronogrid.schemas import CONFIG

    config = "named_struct('page_regions', null, 'day_columns', named_struct('monday', named_struct('left', 0.05D, 'right', null), 'tuesday', named_struct('left', 0.2D, 'right', 0.4D), 'wednesday', null, 'thursday', null, 'friday', null, 'saturday', null, 'sunday', null), 'time_slot_map', array(named_struct('label', 'a', 'top', 0.1D, 'bottom', null), named_struct('label', 'b', 'top', 0.3D, 'bottom', 0.2D)), 'text_patterns', null, 'confidence', 0D, 'layout_signature', '')"
    pages = spark.sql(f"SELECT 'f' AS file, 1 AS page, 1000D AS width, 100D AS height, CAST({config} AS {CONFIG}) AS c")
    r = layout.with_limits(pages, "c").first()
    assert (r.slot_low, r.slot_high, r.rect_left, r.word_right, r.day_max) == (20.0, 30.0, 200.0, 400.0, 45.0)


def test_versions_and_activations_of_runs_side_by_side(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from chronogrid.schemas import CONFIG_DOCUMENT
    from chronogrid.sources import markers

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: markers.claim(spark, str(tmp_path / "m"), "a/b c%", f"run {k}"), range(40)))
    assert sorted(numbers) == list(range(1, 41))
    assert {(r.key, r.number, r.text) for r in markers.read(spark, str(tmp_path / "m")).collect()} == {("a/b c%", n, f"run {k}") for k, n in enumerate(numbers)}

    folder = str(tmp_path / "s")
    row = spark.createDataFrame([("x", "comp1", "COMP1", 0, "draft", "llm", None, None, None, None)], CONFIG_DOCUMENT)
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda k: state.add_version(row, folder, "comp1", f"id{k}"), range(4))) == [1, 2, 3, 4]
    assert state.add_version(row, folder, "other", "o1") == 1
    assert {r.status for r in state.configurations(spark, folder).collect()} == {"draft"}
    for k in (2, 0):
        state.activate(spark, folder, "comp1", f"id{k}")
    got = {r.config_id: (r.version, r.status) for r in state.configurations(spark, folder).collect()}
    assert {i: s for i, (_, s) in got.items()} == {"id0": "active", "id1": "draft", "id2": "superseded", "id3": "draft", "o1": "draft"}
    with pytest.raises(ValueError):
        state.activate(spark, folder, "other", "id1")


def test_replies_are_asked_for_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def flaky(fail):
        class Flaky:
            name, model = "flaky", "m"

            def extract_timetable(self, content):
                with open(calls, "a") as f:
                    f.write(f"{bytes(content).decode()}\n")
                if content in fail:
                    raise RuntimeError("busy")
                return '{"entries": []}'

            def generate_config(self, content, extraction):
                with open(calls, "a") as f:
                    f.write("layout\n")
                return '{"confidence": 0.5}'

        return Flaky()

    docs = spark.createDataFrame([(f"f{k}", bytearray(f"text{k % 4}".encode())) for k in range(12)], "file string, content binary").repartition(3)
    took = lambda: sorted(open(calls).read().split())
    store = str(tmp_path / "replies")
    got = providers.extract(docs, flaky([b"text1"]), store=store, attempts=3, wait=0.01, wave=2)
    assert {(r.file, r.error) for r in got.collect()} == {(f"f{k}", "RuntimeError: busy" if k % 4 == 1 else None) for k in range(12)}
    assert took() == ["text0", "text1", "text1", "text1", "text2", "text3"]
    got = providers.extract(docs, flaky([]), with_config=True, store=store, attempts=3, wait=0.01)
    assert got.where("error IS NULL AND layout.confidence = 0.5").count() == 12
    assert took() == ["layout"] * 4 + ["text0", "text1", "text1", "text1", "text1", "text2", "text3"]
    before = len(took())
    assert providers.extract(docs, flaky([]), with_config=True, store=store).where("error IS NULL").count() == 12 and len(took()) == before


def test_a_document_is_decoded_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def decoder(content):
        with open(calls, "a") as f:
            f.write("x")
        if content == b"bad":
            raise ValueError("broken")
        return [{"width": 1.0, "height": 1.0, "words": [{"text": "a", "x0": 0.0, "x1": 1.0, "top": 0.0, "bottom": 1.0}], "rects": []}]

    docs = spark.createDataFrame([(f"f{k}", bytearray(b"bad" if k == 2 else b"ok")) for k in range(5)], "file string, content binary").repartition(2)
    words, rects, pages, errors = sources.decode(docs, decoder)
    assert (words.count(), rects.count(), pages.count(), [tuple(r) for r in errors.collect()]) == (4, 0, 4, [("f2", "ValueError: broken")])
    assert open(calls).read() == "x" * 5
    assert "PartitionFilters: [isnotnull(kind" in words._jdf.queryExecution().toString()


def test_streamed_sessions_are_those_of_the_whole_log(spark, tmp_path):
    import datetime as dt

    from chronogrid.schemas import SESSION_EVENT
    from chronogrid.streaming import sessions

    rng = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(12):
        for seq in range(rng.randint(1, 9)):
            at = day + dt.timedelta(minutes=10 * seq + rng.randrange(8))
            rows.append((f"s{k}", seq, rng.choice((None, f"C{k}")), rng.choice((None, None, "completed", "failed")), rng.choice((None, "extraction", "report")), rng.choice(("running", "completed")), rng.choice((None, f"id{seq}")), rng.choice((None, seq / 8)), None, None, at))
    rows += [("quiet", 0, "Q", "in_progress", "extraction", "running", None, None, None, None, day), ("busy", 0, "B", "in_progress", "extraction", "running", None, None, None, None, day)]
    late = [("busy", 1, None, None, "extraction", "completed", None, None, None, None, day + dt.timedelta(hours=40)), ("new", 0, "N", "in_progress", None, None, None, None, None, None, day + dt.timedelta(hours=40))]
    log = spark.createDataFrame(rows + late, SESSION_EVENT)
    rng.shuffle(rows)
    src, parts = tmp_path / "in", [rows[:30], rows[30:] + rows[:7], late]  # in any order, some twice
    for part in parts:
        spark.createDataFrame(part, SESSION_EVENT).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(log.schema).parquet(str(src))
        sessions.running(sessions.states(stream, "2 hours", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.session_id: r for r in sessions.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {r.session_id: r for r in calibrate.sessions(log).collect()}
    assert set(got) == set(want)
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    for k, w in want.items():
        g = got[k]
        assert (g.course_code, g.config_id, g.confidence, g.report, g.phases) == (w.course_code, w.config_id, w.confidence, w.report, w.phases or {})
        assert (g.created_us, g.updated_us) == (us(w.created_at), us(w.updated_at))
        assert g.status == ("failed" if k == "quiet" else w.status) and g.timed_out == (k == "quiet")
