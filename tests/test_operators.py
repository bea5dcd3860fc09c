"""Operators on tiny relations; folds against plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import audit, configs, folds, layout, nearest, overlap, records
from chronogrid.schemas import CONFIG


def test_cluster_case_and_shuffle(spark):
    boxes = [(60, 120, 100, 110), (130, 190, 100, 110), (62, 118, 112, 122), (118, 140, 125, 130), (60, 120, 300, 310)]
    want = [(60, 140, 100, 130), (130, 190, 100, 110), (60, 120, 300, 310)]
    rows = [("f", 1, i, *map(float, b)) for i, b in enumerate(boxes)]
    for _ in range(2):
        random.shuffle(rows)
        df = spark.createDataFrame(rows, "file string, page int, seq int, x0 double, x1 double, top double, bottom double").repartition(3)
        assert [(r.x0, r.x1, r.top, r.bottom) for r in folds.clusters(df).orderBy("cluster_idx").collect()] == want


def test_clusters_against_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for page in range(40):
        boxes = []
        for seq in range(rng.randint(0, 12)):
            x, y = rng.randint(0, 200), rng.randint(0, 150)
            boxes.append((float(y), float(x), seq, float(x + rng.randint(5, 60)), float(y + rng.randint(2, 20))))
        rows += [("f", page, s, x0, x1, t, b) for t, x0, s, x1, b in boxes]
        acc = []
        for t, x0, _, x1, b in sorted(boxes):
            for c in acc:
                if x0 < c[1] + 5 and x1 > c[0] - 5 and abs(t - c[3]) < 30:
                    c[:] = [min(c[0], x0), max(c[1], x1), min(c[2], t), max(c[3], b)]
                    break
            else:
                acc.append([x0, x1, t, b])
        for i, c in enumerate(acc):
            want[page, i] = tuple(c)
    df = spark.createDataFrame(rows, "file string, page int, seq int, x0 double, x1 double, top double, bottom double").repartition(5)
    assert {(r.page, r.cluster_idx): (r.x0, r.x1, r.top, r.bottom) for r in folds.clusters(df).collect()} == want


def test_greedy_match_against_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(40):
        side = lambda: [(i, rng.choice("MT"), rng.randrange(480, 800, 30)) for i in range(rng.randint(0, 6))]
        rule, llm = side(), side()
        used, pairs = set(), []
        for i, d, s in rule:
            best = min(((abs(s - t), j) for j, e, t in llm if e == d and j not in used and abs(s - t) <= 90), default=None)
            if best:
                used.add(best[1])
                pairs.append((i, best[1]))
        rows.append((g, rule[::-1], llm[::-1]))
        want[g] = pairs
    kind = "array<struct<idx:int,day:string,start:int>>"
    df = spark.createDataFrame(rows, f"g int, r {kind}, l {kind}")
    got = {r.g: [(m.rule_idx, m.llm_idx) for m in r.m] for r in df.select("g", folds.greedy_match(F.col("r"), F.col("l")).alias("m")).collect()}
    assert got == want


def test_greedy_pairs_against_loop(spark):
    rng = random.Random(5)
    rules, llms, want = [], [], set()
    for g in range(30):
        size = rng.choice((0, 3, 8, 300))
        side = lambda: [(i, rng.choice(("M", "T", None)), rng.choice((rng.randrange(480, 1300, 5), rng.randrange(100000)))) for i in rng.sample(range(1000), size)]
        rule, llm = side(), side()
        used = set()
        for i, d, s in sorted(rule):
            best = min(((abs(s - t), j) for j, e, t in llm if e == d and d and j not in used and abs(s - t) <= 90), default=None)
            if best:
                used.add(best[1])
                want.add((g, i, best[1], best[0]))
        rules += [(g, *r) for r in rule]
        llms += [(g, *r) for r in llm]
    kind = "g int, idx int, day string, start int"
    got = folds.greedy_pairs(spark.createDataFrame(rules, kind).repartition(3), spark.createDataFrame(llms, kind).repartition(4), ["g"])
    assert {tuple(r) for r in got.collect()} == want
    assert folds.greedy_pairs(spark.createDataFrame([], kind), spark.createDataFrame([], kind), ["g"]).count() == 0


def test_islands_shorten_folds(spark):
    rng = random.Random(6)
    rows = [("f", p, s, x := float(rng.randrange(0, 3000)), x + rng.randint(5, 60), y := float(rng.randrange(0, 3000)), y + rng.randint(2, 20)) for p in range(3) for s in range(400)]
    df = spark.createDataFrame(rows, "file string, page int, seq int, x0 double, x1 double, top double, bottom double").repartition(4)
    parts = [r["count"] for r in folds.islands(df, ["file", "page"]).groupBy("file", "page", "island", "part").count().collect()]
    print("longest fold before and after:", 400, max(parts))
    assert sum(parts) == 1200 and max(parts) < 200
    want = {}
    for page in range(3):
        acc = []
        for t, x0, _, x1, b in sorted((r[5], r[3], r[2], r[4], r[6]) for r in rows if r[1] == page):
            for c in acc:
                if x0 < c[1] + 5 and x1 > c[0] - 5 and abs(t - c[3]) < 30:
                    c[:] = [min(c[0], x0), max(c[1], x1), min(c[2], t), max(c[3], b)]
                    break
            else:
                acc.append([x0, x1, t, b])
        want |= {(page, i): tuple(c) for i, c in enumerate(acc)}
    assert {(r.page, r.cluster_idx): (r.x0, r.x1, r.top, r.bottom) for r in folds.clusters(df).collect()} == want


def test_place_streams_against_loop(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for plan in range(12):
        placed = []
        for g in range(rng.randint(0, 40)):
            options = [(plan, g, q, f"k{q}", rng.choice("MTW"), rng.randrange(0, 1440), rng.choice((0, rng.randrange(0, 1500)))) for q in range(rng.randint(1, 4))]
            rows += options
            best = min(options, key=lambda o: (sum(p[4] == o[4] and p[5] < o[6] and o[5] < p[6] for p in placed), o[2]))
            placed.append(best)
            want.add((plan, g, best[3], best[4], best[5], best[6]))
    df = spark.createDataFrame(rows, "plan int, g int, seq int, key string, day string, start int, end int").repartition(5)
    assert {tuple(r) for r in folds.place_streams(df, ["plan"], ["g"]).collect()} == want


def test_conflicts_of_a_hot_day(spark):
    rng = random.Random(8)
    rows = [(i, "M" if rng.random() < 0.9 else rng.choice(("T", None)), rng.choice("abc"), s := rng.randrange(0, 1440), s + rng.choice((0, 1, 5, 30, 600, -3))) for i in range(700)]
    want = {(a[0], b[0], a[1]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[1] and a[2] != b[2] and a[3] < b[4] and b[3] < a[4]}
    df = spark.createDataFrame(rows, "i int, day string, course string, s int, e int").repartition(3)
    for bucket in (None, 60):
        got = overlap.conflicts(df, ["day"], "s", "e", "i", "course", bucket, block_rows=50)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    alone = overlap.conflicts(df, [], "s", "e", "i", None, 60, block_rows=64)
    assert alone.count() == sum(1 for a in rows for b in rows if a[0] < b[0] and a[3] < b[4] and b[3] < a[4])


def test_conflicts_in_buckets_are_a_join(spark):
    """No Python meets the pairs; times may have fractions, and an interval may end before it starts."""
    rng = random.Random(31)
    rows = [(k, rng.choice("MT"), rng.choice("abc"), s := rng.randrange(0, 2000) / 8, s + rng.choice([-3.5, 0.0, 0.25, 0.875, 7.0, 59.625, 130.125])) for k in range(300)]
    rows += [(300, "M", "a", 0.5, 60.875), (301, "M", "b", 60.25, 61.0)]
    df = spark.createDataFrame(rows, "i int, day string, course string, s double, e double")
    want = sorted((a[0], b[0], a[1]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and a[3] < b[4] and b[3] < a[4])
    for block_rows in (7, 2048):
        got = overlap.conflicts(df, ["day"], "s", "e", "i", "course", 60, block_rows)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert "InArrow" not in _plan(got) and "Join Inner" in _plan(got)


def test_nearest_and_days(spark):
    slots = F.expr("array(struct(100D as x_start, 200D as x_end, '08:00AM' as label, 0 as idx), struct(200D as x_start, 250D as x_end, '09:00AM' as label, 1 as idx))")
    df = spark.createDataFrame([(150.0,), (180.0,)], "x double")
    assert [r.s for r in df.select(nearest.nearest_label(F.col("x"), slots).alias("s")).collect()] == ["08:00AM", "09:00AM"]
    none = F.array().cast("array<struct<x_start:double,x_end:double,label:string,idx:int>>")
    assert df.select(nearest.range_labels(F.col("x"), F.col("x"), none).alias("s")).first().s.start == "?"
    bands = F.expr("array(struct(300D as y_top, 310D as y_bottom, 'Tuesday' as day, 1 as seq), struct(100D as y_top, 110D as y_bottom, 'Monday' as day, 0 as seq))")
    ys = spark.createDataFrame([(10.0,), (249.0,), (250.0,)], "y double")
    assert [r.d for r in ys.select(nearest.day_at(F.col("y"), bands).alias("d")).collect()] == ["Monday", "Monday", "Tuesday"]
    assert ys.select(nearest.day_at(F.col("y"), F.array().cast("array<struct<y_top:double,y_bottom:double,day:string,seq:int>>")).alias("d")).first().d == "Unknown"


@pytest.mark.parametrize("bucket", [None, 30])
def test_conflicts(spark, bucket):
    rows = [(0, "M", "a", 480, 540), (1, "M", "b", 540, 600), (2, "M", "c", 500, 560), (3, "M", "a", 500, 520), (4, "T", "d", 480, 540)]
    df = spark.createDataFrame(rows, "i int, day string, course string, s int, e int")
    got = {(r.first, r.second) for r in overlap.conflicts(df, ["day"], "s", "e", "i", "course", bucket).collect()}
    assert got == {(0, 2), (1, 2), (2, 3)}


def test_audit(spark):
    rows = [("f", p, "08:00AM", x, x + 5, 100.0, 110.0) for p, x in enumerate([10.0, 10.0, 15.0, 20.0])] + [("f", 0, "09:00AM", 50.0, 55.0, 100.0, 110.0)]
    h = spark.createDataFrame(rows, "file string, page int, label string, x0 double, x1 double, top double, bottom double")
    d = audit.discrepancies(h, 5.0).collect()
    assert [(r.page, r.expected_x, r.delta) for r in d] == [(3, 12.5, 7.5)]
    s = {r.label: r for r in audit.spread(h, audit.expected_labels(spark), "label", "x0").collect()}
    assert len(s) == 14 and s["09:00AM"].deviation == 0.0 and s["10:00AM"].status == "no data"
    pages = spark.createDataFrame([("f", p, 1.0, 1.0) for p in range(5)], "file string, page int, width double, height double")
    m = {r.page: r.missing for r in audit.missing_headers(pages, h).collect()}
    assert len(m[4]) == 14 and m[0][0] == "10:00AM"
    exact = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 10.0)], "l string, v double")
    assert audit.outliers(exact, "l", "v", 5.0).count() == 0


def test_first_wins_nulls_and_activation(spark):
    df = spark.createDataFrame([("M", None, 2), ("M", None, 1), ("M", "C", 3)], "day string, course string, i int")
    assert sorted(r.i for r in records.first_wins(df, ["day", "course"], ["i"]).collect()) == [1, 3]
    c = spark.createDataFrame([("1", "A", "active"), ("2", "a", "active"), ("3", "A", "draft"), ("4", "B", "active")], "config_id string, course_code string, status string")
    status = lambda i: {r.config_id: r.status for r in records.activate(c, i).collect()}
    assert status("3") == {"1": "superseded", "2": "superseded", "3": "active", "4": "active"}
    assert status("9") == {"1": "active", "2": "active", "3": "draft", "4": "active"}


def test_filters(spark):
    df = spark.createDataFrame([("1", "Module", "", "COMP 1", "DCIT", "FST"), ("2", "module", "", "MATH 2", "DMS", "FST"), ("3", "room", "", "COMP 3", "DCIT", "FSS")], "id string, type string, link string, name string, dept string, faculty string")
    ids = lambda **k: [r.id for r in records.filter_resources(df, **k).orderBy("id").collect()]
    assert ids(res_type="MODULE") == ["1", "2"] and ids(faculty="fs", codes=["comp"]) == ["1", "3"] and ids(dept="dc", limit=1) == ["1"] and ids(limit=0) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        records.filter_resources(df, all_resources=False)


def test_derived_configuration(spark):
    entry = "struct<day:string,start_time:string,end_time:string,room:string,activity_type:string,staff:string>"
    layout = "struct<page_regions:struct<header_top:double,header_bottom:double,table_top:double,table_bottom:double,footer_bottom:double>>"
    rows = [(([("Tues", "02:00 PM", "03:00 PM", None, None, None), ("Mon", "08:00 AM", "09:00 AM", None, None, None), ("Tue", "02:00 PM", "03:00 PM", None, None, None)],),)]
    from chronogrid.schemas import CONFIG

    df = spark.createDataFrame(rows, f"x struct<entries:array<{entry}>>").withColumn("l", F.lit(None).cast(CONFIG))
    assert layout
    c = configs.generate(df, "x", "l").first().config
    assert (c.day_columns.tuesday.left, c.day_columns.monday.right, c.day_columns.friday) == (0.0, 1.0, None)
    assert [s.label for s in c.time_slot_map] == ["08:00 AM - 09:00 AM", "02:00 PM - 03:00 PM"] and c.time_slot_map[1].top == 840 / 1440
    assert configs.generate(df, "x", "l", twelve_hours=False).first().config.time_slot_map[0].label == "02:00 PM - 03:00 PM"
    assert c.confidence == 0.0 and c.page_regions.footer_bottom == 0.92
    s = configs.summary(spark.createDataFrame([("1", "A", 1, "draft")], "config_id string, course_code string, version int, status string").crossJoin(configs.generate(df, "x", "l").select("config"))).first()
    assert (s.n_days, s.first_slot, s.confidence_class) == (2, "08:00 AM - 09:00 AM", "low")


def test_nearest_within_keeps_every_row(spark):
    left = spark.createDataFrame([("a", 10, {"x": 1}), ("a", 10, {"x": 1}), ("b", 5, None), (None, 1, None), ("a", None, None), ("a", 99, None)], "k string, t int, m map<string,int>").repartition(3)
    right = spark.createDataFrame([("a", 12, 7), ("a", 8, 3), ("a", 14, 1), ("b", 50, 2), (None, 1, 9)], "k string, t int, id int")
    got = sorted(((r.k, r.t, r.id, r.distance) for r in nearest.nearest_within(left, right, ["k"], "t", "t", 5, "id").collect()), key=str)
    assert got == sorted([("a", 10, 3, 2), ("a", 10, 3, 2), ("b", 5, None, None), (None, 1, None, None), ("a", None, None, None), ("a", 99, None, None)], key=str)
    points = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "at double, label string")
    rows = nearest.nearest_in_table(spark.createDataFrame([(1.5,), (1.5,), (9.0,), (None,)], "v double"), "v", points, "at", "label", 1.0).collect()
    assert sorted(((r.v, r.nearest_label, r.nearest_distance) for r in rows), key=str) == sorted([(1.5, "x", 0.5), (1.5, "x", 0.5), (9.0, None, None), (None, None, None)], key=str)


@pytest.mark.parametrize("offset, default_first, bucket", [(0, False, 3), (7, True, 100_000), (0, False, 10), (7, True, 10), (-5, True, 1000)])
def test_asof_against_loop(spark, offset, default_first, bucket):
    rng = random.Random(23)
    left = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(100), i) for i in range(120)]
    right = [(rng.choice("ab"), t, 1000 + t) for t in rng.sample(range(10, 100), 40)] + [(None, 50, 5000)]
    got = {r.i: r.v for r in nearest.asof(spark.createDataFrame(left, "k string, t int, i int").repartition(4), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", "t", "v", bucket, offset, default_first).collect()}
    for k, t, i in left:
        mine = sorted((u, v) for kk, u, v in right if kk == k)
        before = [v for u, v in mine if u <= t + offset]
        assert got[i] == (before[-1] if before else mine[0][1] if mine and default_first else None)
    assert len(got) == len(left)


def test_medians_against_sorting(spark):
    import statistics

    rng = random.Random(24)
    rows = [(label, float(v)) for label, n in (("a", 1), ("b", 2), ("c", 5), ("d", 4000), ("e", 4001), (None, 6)) for v in (rng.choice((rng.randrange(10), rng.gauss(0, 1e6))) for _ in range(n))] + [("a", None), ("none", None)]
    got = {r.l: r.expected for r in audit.expected_positions(spark.createDataFrame(rows, "l string, v double").repartition(7), "l", "v").collect()}
    assert got == {x: statistics.median(v for label, v in rows if label == x and v is not None) for x in ("a", "b", "c", "d", "e", None)}


def test_supersede_ties_and_missing_keys(spark):
    df = spark.createDataFrame([("a", 1, "active"), ("a", 2, "draft"), ("a", 2, "active"), (None, 1, "active")], "k string, v int, s string")
    got = sorted((tuple(r) for r in records.supersede(df, "k", ["v"], "s", "active", "superseded").collect()), key=str)
    assert got == sorted([("a", 1, "superseded"), ("a", 2, "active"), ("a", 2, "active"), (None, 1, "active")], key=str)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_configuration_values_are_computed_once(spark):
    """Days and slots of entries, and what is compared, stand once in the plan, and are not computed once more in a filter."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    schema = "entries array<struct<day:string,start_time:string,end_time:string>>"
    df = spark.createDataFrame([([("Mon", "9:00 AM", "10:00 AM"), ("Fri", "8:00 AM", ""), ("mon", "9:00 AM", "10:00 AM"), (None, "08:00 AM", "09:00 AM"), ("Fri", None, "x")],), ([],), (None,)], schema)
    days = df.select(configs.day_columns(configs.derived_columns(F.col("entries"))).alias("d"))
    assert _plan(days).count("s+$") == 1
    got = days.collect()
    assert [got[0].d[k] and tuple(got[0].d[k]) for k in ("monday", "tuesday", "friday")] == [(0.0, 0.5), None, (0.5, 1.0)]
    assert set(got[1].d) == set(got[2].d) == {None}
    slots = df.select(configs.derived_slots(F.col("entries")).alias("s"))
    assert _plan(slots).count("concat(") == 1
    assert [r.s and [x.label for x in r.s] for r in slots.collect()] == [["08:00 AM - 09:00 AM", "9:00 AM - 10:00 AM"], [], None]
    made = configs.generate(df.select(F.struct(F.array().cast("array<struct<day:string,start_time:string,end_time:string,room:string,activity_type:string,staff:string>>").alias("entries")).alias("e"), F.lit(None).cast(CONFIG).alias("l")), "e", "l").select("config")
    other = F.col("config").withField("page_regions", F.col("config.page_regions").withField("table_top", F.lit(0.0321)))
    compared = made.select(configs.compare(F.col("config"), other).alias("d"))
    assert _plan(compared).count("0.0321") == 1
    assert [(r.d.region_deltas.table_top, r.d.changed) for r in compared.collect()] == [(0.1179, ["page_regions"])] * 3


def test_derived_slots_are_not_made_to_filter_the_scan(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["derived_slots"](spark, "/root/testdata/sf0.001"))
    scan = plan[plan.index("RepartitionByExpression"):]
    assert "Filter" not in scan and "from_json" not in scan


def test_clusters_of_boxes_that_touch_by_rounding(spark):
    """10.04 >= (0.04 + 5) + 5, but 0.04 + 5 > 10.04 - 5: the fold joins the two, so no island may part them."""
    rows = [("f", 1, 0, 0.04, 0.04 + 5, 2.0, 6.0), ("f", 1, 1, 10.04, 10.04 + 5, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "file string, page int, seq int, x0 double, x1 double, top double, bottom double")
    assert [(r.x0, r.x1) for r in folds.clusters(df).collect()] == [(0.04, 15.04)]


def test_nearest_makes_no_pairs(spark):
    """Many rows within one cell are sorted, not paired; places at cell edges, ties, equal rows, nulls and infinite places against a loop."""
    rng = random.Random(7)
    most = 25.0
    left = [(i % 3, rng.choice([None, float("nan"), float("inf"), -1e-17, 24.999999999999996, 50.0, *[rng.randint(-90, 90) / 2 for _ in range(12)]]), i // 2) for i in range(400)]
    right = [(rng.choice([0, 1, None]), rng.choice([None, float("nan"), float("inf"), 25.0, 49.99999999999999, *[rng.randint(-90, 90) / 2 for _ in range(5)]]), i) for i in range(60)]
    l = spark.createDataFrame(left, "k int, x double, n int").repartition(3)  # noqa: E741
    r = spark.createDataFrame(right, "k int, y double, id int").repartition(3)
    want = []
    for k, x, n in left:
        near = [(abs(x - y), i) for q, y, i in right if q is not None and q == k and x is not None and y is not None and abs(x - y) <= most]
        want.append((k, repr(x), n, *(min(near)[::-1] if near else (None, None))))
    out = nearest.nearest_within(l, r, ["k"], "x", "y", most, "id")
    assert sorted(((g.k, repr(g.x), g.n, g.id, g.distance) for g in out.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in _plan(out)


def test_next_lower_makes_no_pairs(spark):
    """Against every pair: equal heights, edges of the tolerance, rows without a place, a hot column cut into blocks."""
    rng = random.Random(5)
    near = lambda: rng.choice([None, float("nan"), float("inf"), -3.0, 899.01, 909.01, 919.01, rng.randrange(0, 4000) / 100, rng.uniform(-200, 200), 0.1 * rng.randrange(-300, 300)])
    rows = [(k, rng.choice(["a", "b", None]), near(), rng.choice([None, float(rng.randrange(40)), rng.uniform(0, 40)])) for k in range(500)]
    rows += [(k, "hot", 5.0 + k % 3 * 6, float(k // 7)) for k in range(500, 800)]
    df = spark.createDataFrame(rows, "i int, k string, x double, y double").repartition(3)
    want = []
    for i, k, x, y in rows:
        low = [b[3] for b in rows if k is not None and b[1] == k and None not in (x, y, b[2], b[3]) and abs(x - b[2]) < 10 and b[3] > y]
        want.append((i, min(low) - 2 if low else y + 130 if y is not None else None))
    for block_rows in (8, 1 << 16):
        out = overlap.next_lower(df, ["k"], "x", "y", "i", block_rows=block_rows)
        assert out.columns == [*df.columns, "y_bottom"]
        assert sorted((r.i, r.y_bottom) for r in out.collect()) == sorted(want)
    assert _plan(out).count("Join") == 1  # the rows with what was found


def test_boxes_end_within_their_page(spark):
    """y_bottom of each cluster is that of next_lower, with one grouping of the boxes in the plan."""
    rng = random.Random(3)
    rows = [("f", p, i, float(rng.randint(51, 400)), 0.0, float(rng.randint(0, 500)), 0.0, 60.0, True) for p in range(6) for i in range(rng.randint(1, 25))]
    rects = spark.createDataFrame([(*r[:4], r[3] + 60, r[5], r[5] + 9, *r[7:]) for r in rows], "file string, page int, seq int, x0 double, x1 double, top double, bottom double, width double, fill boolean")
    limits = layout.with_limits(spark.createDataFrame([("f", p, 800.0, 600.0) for p in range(6)], "file string, page int, width double, height double"))
    made = layout.boxes(rects, limits)
    assert _plan(made).count("collect_list") == 1
    want = overlap.next_lower(made.drop("y_bottom"), layout.PAGE, "x0", "top", "cluster_idx")
    keep = ["page", "cluster_idx", "x0", "x1", "top", "bottom", "y_bottom"]
    assert sorted(made.select(keep).collect()) == sorted(want.select(keep).collect())
