"""Queries over the given tables, one for each operator family, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, text, times
from ..operators import audit, configs, folds, nearest, overlap, records
from ..session import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """events with sec (seconds since 1970), day and minute of day."""
    at = F.col("ts").cast("timestamp")
    return load(spark, folder, "events").withColumns({"sec": F.unix_seconds(at), "us": F.unix_micros(at), "day": F.date_format(at, "yyyy-MM-dd"), "minute": (F.hour(at) * 60 + F.minute(at)).cast("int")})


E = "(SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute FROM events)"


# -- consistency ------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS expected FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, expected, abs(l_extendedprice - expected) AS delta FROM lineitem JOIN m USING (l_returnflag) WHERE abs(l_extendedprice - expected) > 20000""")
def audit_outliers(spark, folder):
    return audit.outliers(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", 20000)


_TYPES = ("click", "purchase", "view", "login", "error", "refund")


@query("""WITH e AS (SELECT unnest(['click','purchase','view','login','error','refund']) AS event_type, unnest([0,1,2,3,4,5]) AS idx),
s AS (SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS greatest, round(stddev_pop(value), 4) AS deviation, count(value) AS n FROM events GROUP BY 1)
SELECT e.idx, e.event_type, s.median, s.least, s.greatest, s.deviation, coalesce(s.n, 0) AS n, CASE WHEN s.n IS NULL THEN 'no data' WHEN s.greatest - s.least <= 10 THEN 'ok' ELSE 'spread' END AS status FROM e LEFT JOIN s USING (event_type)""")
def audit_spread_stats(spark, folder):
    expected = audit.expected_labels(spark, _TYPES).withColumnRenamed("label", "event_type")
    return audit.spread(load(spark, folder, "events"), expected, "event_type", "value").withColumn("deviation", F.round("deviation", 4))


@query(f"""WITH f AS (SELECT user_id, day, list(DISTINCT event_type) AS found FROM {E} GROUP BY 1, 2),
m AS (SELECT user_id, day, list_filter(['click','purchase','view','login','error','refund'], lambda x: NOT list_contains(found, x)) AS missing FROM f)
SELECT user_id, day, array_to_string(missing, '; ') AS missing FROM m WHERE len(missing) > 0""")
def audit_missing_labels(spark, folder):
    return audit.missing_labels(_events(spark, folder), ["user_id", "day"], "event_type", F.array(*map(F.lit, _TYPES))).withColumn("missing", F.array_join("missing", "; "))


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS expected FROM lineitem GROUP BY 1)
SELECT CAST((SELECT count(*) FROM lineitem JOIN m USING (l_returnflag) WHERE abs(l_extendedprice - expected) > 20000) + (SELECT count(*) FROM part WHERE p_size > 40) AS BIGINT) AS issues""")
def audit_verdict(spark, folder):
    return audit.verdict(audit_outliers(spark, folder), load(spark, folder, "part").where("p_size > 40"))


# -- nearest and as-of ------------------------------------------------------------------------


@query("""WITH s AS (SELECT i AS idx, i * 5000.0 AS x, 'S' || i AS label FROM range(20) t(i))
SELECT l_orderkey, l_linenumber, l_extendedprice, arg_min(label, struct_pack(d := abs(l_extendedprice - x), i := idx)) AS label FROM (SELECT *, row_number() OVER () AS r FROM lineitem), s GROUP BY r, 1, 2, 3""")
def nearest_slot(spark, folder):
    slots = F.array(*(F.struct(F.lit(i * 5000.0).alias("x_start"), F.lit((i + 1) * 5000.0).alias("x_end"), F.lit(f"S{i}").alias("label"), F.lit(i).alias("idx")) for i in range(20)))
    return load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", nearest.nearest_label(F.col("l_extendedprice"), slots).alias("label"))


@query("""WITH p AS (SELECT c_custkey, min(struct_pack(d := abs(c_acctbal - p_retailprice), k := p_partkey)) AS m FROM customer JOIN part ON abs(c_acctbal - p_retailprice) <= 25 GROUP BY 1)
SELECT c_custkey, m.k AS nearest_label, m.d AS nearest_distance FROM customer LEFT JOIN p USING (c_custkey)""")
def nearest_price(spark, folder):
    return nearest.nearest_in_table(load(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", load(spark, folder, "part"), "p_retailprice", "p_partkey", 25.0).drop("c_acctbal")


@query(f"""WITH m AS (SELECT c.event_id, min(struct_pack(d := abs(c.sec - p.sec), k := p.event_id)) AS m FROM {E} c JOIN {E} p ON c.user_id = p.user_id AND abs(c.sec - p.sec) <= 5400 WHERE c.event_type = 'click' AND p.event_type = 'purchase' GROUP BY 1)
SELECT event_id, m.k AS purchase_id, m.d AS distance FROM events LEFT JOIN m USING (event_id) WHERE event_type = 'click'""")
def nearest_within_tolerance(spark, folder):
    e = _events(spark, folder)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "sec")
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "sec")
    return nearest.nearest_within(clicks, bought, ["user_id"], "sec", "sec", 5400, "purchase_id").select("event_id", "purchase_id", "distance")


@query(f"""SELECT c.event_id, v.event_id AS view_id FROM (SELECT *, us + 50000000 AS at FROM {E} WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM {E} WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.at >= v.us""")
def asof_offset(spark, folder):
    e = _events(spark, folder)
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "us")
    return nearest.asof(e.where("event_type = 'click'").select("event_id", "user_id", "us"), views, ["user_id"], "us", "us", "view_id", 86_400_000_000, 50_000_000).select("event_id", "view_id")


@query(f"""WITH v AS (SELECT * FROM {E} WHERE event_type = 'view'), f AS (SELECT user_id, arg_min(event_id, us) AS first_id FROM v GROUP BY 1)
SELECT c.event_id, coalesce(v.event_id, f.first_id) AS view_id FROM (SELECT * FROM {E} WHERE event_type = 'click') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.us >= v.us LEFT JOIN f ON c.user_id = f.user_id""")
def asof_first_default(spark, folder):
    e = _events(spark, folder)
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "us")
    return nearest.asof(e.where("event_type = 'click'").select("event_id", "user_id", "us"), views, ["user_id"], "us", "us", "view_id", 86_400_000_000, default_first=True).select("event_id", "view_id")


@query(f"SELECT event_id, us AS start_us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + 50) AS end_us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {E}")
def lead_interval(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return _events(spark, folder).select("event_id", F.col("us").alias("start_us"), F.coalesce(F.lead("us").over(w), F.col("us") + 50).alias("end_us"), (F.row_number().over(w) - 1).cast("long").alias("idx"))


# -- overlaps and ranges ----------------------------------------------------------------------


@query(f"""SELECT a.event_id AS first, b.event_id AS second, a.day FROM {E} a JOIN {E} b ON a.day = b.day AND a.event_id < b.event_id AND a.user_id <> b.user_id AND a.minute < b.minute + 60 AND b.minute < a.minute + 60""")
def interval_conflicts(spark, folder):
    e = _events(spark, folder).withColumn("until", F.col("minute") + 60)
    return overlap.conflicts(e, ["day"], "minute", "until", "event_id", "user_id", bucket=60)


@query("""SELECT p_partkey, b.i AS band FROM part JOIN range(100) b(i) ON p_retailprice >= 900 + i * 11.5 AND p_retailprice < 900 + i * 11.5 + 20""")
def band_join(spark, folder):
    boxes = spark.range(100).select(F.col("id").alias("band"), (900 + F.col("id") * 11.5).alias("low"), (900 + F.col("id") * 11.5 + 20).alias("high"))
    return overlap.binned_band_join(load(spark, folder, "part").select("p_partkey", "p_retailprice"), boxes, "p_retailprice", "low", "high", 20.0).select("p_partkey", "band")


@query("""SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN (SELECT l_returnflag AS flag, q AS band, q * 10.0 AS low, q * 10.0 + 15 AS high FROM (SELECT DISTINCT l_returnflag FROM lineitem), range(5) t(q)) b
ON l_returnflag = flag AND l_quantity >= low AND l_quantity <= high""")
def keyed_band_join(spark, folder):
    l = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")  # noqa: E741
    q = F.explode(F.sequence(F.lit(0), F.lit(4)))
    boxes = l.select("l_returnflag").distinct().withColumn("band", q).select("l_returnflag", F.col("band").cast("long"), (F.col("band") * 10.0).alias("low"), (F.col("band") * 10.0 + 15).alias("high"))
    return overlap.binned_band_join(l, boxes, "l_quantity", "low", "high", 10.0, ["l_returnflag"], closed=True).select("l_orderkey", "l_linenumber", "band")


@query("""WITH p AS (SELECT p_partkey, p_size, p_retailprice, CAST(p_partkey AS DOUBLE) AS h FROM part),
m AS (SELECT a.p_partkey, min(b.h) AS low FROM p a JOIN p b ON a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) < 10 AND b.h > a.h AND a.p_partkey <> b.p_partkey GROUP BY 1)
SELECT p.p_partkey, coalesce(low - 2, h + 130) AS y_bottom FROM p LEFT JOIN m USING (p_partkey)""")
def next_lower_same_column(spark, folder):
    p = load(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", F.col("p_partkey").cast("double").alias("h"))
    return overlap.next_lower(p, ["p_size"], "p_retailprice", "h", "p_partkey").select("p_partkey", "y_bottom")


@query(f"""SELECT a.user_id AS file, a.day AS page, a.event_id AS anchor_seq, string_agg(b.event_type, ' ' ORDER BY b.event_id) AS line FROM {E} a JOIN {E} b ON a.user_id = b.user_id AND a.day = b.day AND abs(a.minute - b.minute) < 5 WHERE a.event_type = 'purchase' GROUP BY 1, 2, 3""")
def same_line(spark, folder):
    w = _events(spark, folder).select(F.col("user_id").alias("file"), F.col("day").alias("page"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.col("minute").alias("top"), F.lit(100).alias("x0"))
    return overlap.same_line(w, ["file", "page"], "purchase")


# -- lookups, filters, dedup, versions --------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE reverse(dayname(l_shipdate)) WHEN 'yadnoM' THEN 'Monday' WHEN 'yadseuT' THEN 'Tuesday' WHEN 'yadsendeW' THEN 'Wednesday' WHEN 'yadsruhT' THEN 'Thursday' WHEN 'yadirF' THEN 'Friday' WHEN 'yadrutaS' THEN 'Saturday' WHEN 'yadnuS' THEN 'Sunday' END AS day FROM lineitem""")
def dict_lookup(spark, folder):
    label = F.reverse(F.date_format(F.col("l_shipdate").cast("timestamp"), "EEEE"))
    return load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", keys.day_of_label(label).alias("day"))


_SPELLINGS = ("lec", " LAB", "tute", "Seminar ", "wrk", "Postgraduate")


@query("SELECT o_orderkey, ['Lecture', 'Lab', 'Tutorial', 'Seminar', 'Workshop', 'Other'][CAST(o_orderkey % 6 + 1 AS BIGINT)] AS kind FROM orders")
def type_aliases(spark, folder):
    return load(spark, folder, "orders").select("o_orderkey", keys.activity(F.get(F.array(*map(F.lit, _SPELLINGS)), (F.col("o_orderkey") % 6).cast("int"))).alias("kind"))


@query(f"SELECT event_id, user_id, event_type, day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY us, event_id) AS n FROM {E}) WHERE n = 1")
def first_wins_dedup(spark, folder):
    return records.first_wins(_events(spark, folder).select("event_id", "user_id", "event_type", "day", "us"), ["user_id", "event_type", "day"], ["us", "event_id"]).drop("us")


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_active(spark, folder):
    return records.latest(load(spark, folder, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("""SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active' WHEN o_orderstatus = 'O' THEN 'superseded' ELSE o_orderstatus END AS status FROM orders""")
def supersede(spark, folder):
    o = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "active").otherwise(F.col("o_orderstatus")).alias("status"))
    return records.supersede(o, "o_custkey", ["o_orderdate", "o_orderkey"], "status", "active", "superseded").drop("o_orderdate")


@query("""SELECT o_orderkey AS config_id, CASE WHEN o_orderkey = t.k THEN 'active' WHEN o_custkey = t.c AND o_orderstatus = 'O' THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'draft' END AS status
FROM orders, (SELECT max(o_orderkey) AS k, arg_max(o_custkey, o_orderkey) AS c FROM orders) t""")
def activate_version(spark, folder):
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("config_id"), F.col("o_custkey").cast("string").alias("course_code"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"))
    return records.activate(o, o.agg(F.max("config_id")).first()[0]).select("config_id", "status")


@query("""SELECT p_partkey AS id, p_type AS type, p_name AS name, p_brand AS dept FROM part WHERE contains(lower(p_brand), 'brand#1') AND (contains(upper(p_name), 'A') OR contains(upper(p_name), '7')) ORDER BY 1 LIMIT 25""")
def resource_filter_topk(spark, folder):
    p = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("dept"))
    return records.filter_resources(p, dept="BRAND#1", codes=["a", "7"], limit=25)


@query("""SELECT p_partkey AS id, ['Module', 'room', 'STAFF'][CAST(p_partkey % 3 + 1 AS BIGINT)] AS type, p_name AS name, p_brand AS dept, CASE WHEN p_size % 5 <> 0 THEN 'Faculty of ' || p_type END AS faculty FROM part WHERE p_partkey % 3 = 0 AND contains(lower('Faculty of ' || p_type), 'of s') AND p_size % 5 <> 0""")
def resources_of_a_faculty(spark, folder):
    kind = F.get(F.array(*map(F.lit, ("Module", "room", "STAFF"))), (F.col("p_partkey") % 3).cast("int"))
    p = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), kind.alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("dept"), F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("Faculty of "), "p_type")).alias("faculty"))
    return records.filter_resources(p, res_type="mODULE", faculty="OF S", all_resources=False)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_recent(spark, folder):
    return records.recent(load(spark, folder, "orders"), "o_orderdate", "o_orderkey", 20, F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id LIMIT 50")
def sample_k(spark, folder):
    return records.sample_rows(load(spark, folder, "documents").select("doc_id", "source"), "doc_id", 50)


@query(f"SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (value > 50) AS value FROM {E} GROUP BY 1")
def fold_events(spark, folder):
    e = _events(spark, folder).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return records.fold_events(e, "user_id", "event_id", ["event_type", "value"])


@query("""WITH d AS (SELECT c.c_nationkey AS k, count(*) AS n FROM customer c GROUP BY 1)
SELECT n_nationkey, coalesce(d.n, -1) AS config FROM nation LEFT JOIN (SELECT * FROM d WHERE n > 60) d ON n_nationkey = d.k""")
def config_cascade(spark, folder):
    d = load(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("config")).where("config > 60")
    return records.cascade(load(spark, folder, "nation").select("n_nationkey"), "n_nationkey", d, "config", F.lit(-1))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'skip' ELSE 'download' END AS action FROM part""")
def download_plan(spark, folder):
    have = load(spark, folder, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id"))
    return records.download_plan(load(spark, folder, "part").select(F.col("p_partkey").alias("id")), have, "id")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS downloaded, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def download_counters(spark, folder):
    outcome = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skip").otherwise("fail")
    return records.download_counters(load(spark, folder, "orders").select(outcome.alias("outcome")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def only_left(spark, folder):
    return records.without(load(spark, folder, "part").select("p_partkey"), load(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


# -- comparison -------------------------------------------------------------------------------


@query("""WITH j AS (SELECT c_custkey AS k, c_name, s_name, c_nationkey, s_nationkey, c_mktsegment FROM customer JOIN supplier ON c_custkey = s_suppkey)
SELECT k, 'room' AS field, c_name AS rule, s_name AS llm FROM j WHERE upper(trim(c_name)) <> upper(trim(s_name))
UNION ALL SELECT k, 'staff', c_name, CASE WHEN k % 3 = 0 THEN s_name ELSE upper(c_name) || ' ,' END FROM j WHERE k % 3 = 0 AND upper(c_name) <> upper(s_name)
UNION ALL SELECT k, 'nation', CAST(c_nationkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM j WHERE c_nationkey <> s_nationkey""")
def field_diff(spark, folder):
    c, s = load(spark, folder, "customer"), load(spark, folder, "supplier")
    j = c.join(s, c.c_custkey == s.s_suppkey).select(F.col("c_custkey").alias("k"), F.struct(F.col("c_name").alias("room"), F.col("c_name").alias("staff"), F.col("c_nationkey").alias("nation")).alias("rule"), F.struct(F.col("s_name").alias("room"), F.when(F.col("c_custkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.upper("c_name"), F.lit(" ,"))).alias("staff"), F.col("s_nationkey").alias("nation")).alias("llm"))
    return records.field_diff(j, ["k"], fields=("room", "staff", "nation"))


@query("""WITH a AS (SELECT c_nationkey AS nation, count(*) AS before FROM customer WHERE c_acctbal > 9000 GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS after FROM supplier GROUP BY 1)
SELECT nation, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before = after THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (nation)""")
def outer_diff(spark, folder):
    a = load(spark, folder, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return records.outer_diff(a, load(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")), "nation", "n")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, round(least(clicks, purchases) / greatest(clicks, purchases, 1), 6) AS match_rate FROM events GROUP BY 1""")
def match_summary(spark, folder):
    g = load(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return g.withColumn("match_rate", F.round(records.match_rate(F.least("clicks", "purchases"), F.col("clicks"), F.col("purchases")), 6))


# -- scalars ----------------------------------------------------------------------------------

_BLOCK_SQL = """['Lecture', 'lab', 'Tutorial', 'Talk'][CAST(p_partkey % 4 + 1 AS BIGINT)] || ', Wks S2W' || (p_size % 9 + 1) || '- S2W' || (p_size % 9 + 3) || ' [=' || p_size || '] Course: ' || p_brand || ' (L' || (p_partkey % 5) || ') Staff: ' || p_name || ' Room: ' || p_type || ' W'"""


@query(f"""WITH t AS (SELECT p_partkey, {_BLOCK_SQL} AS raw, regexp_replace({_BLOCK_SQL}, '(S\\d+W\\d+)-\\s+(S\\d+W\\d+)', '\\1-\\2', 'g') AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)\\bLecture\\b') THEN 'Lecture' WHEN regexp_matches(t, '(?i)\\bLab\\b') THEN 'Lab' WHEN regexp_matches(t, '(?i)\\bTutorial\\b') THEN 'Tutorial' END AS type,
  nullif(regexp_extract(t, 'S\\d+W\\d+-S\\d+W\\d+'), '') AS weeks, TRY_CAST(regexp_extract(t, '\\[=(\\d+)\\]', 1) AS INTEGER) AS week_count,
  trim(regexp_replace(regexp_extract(t, '.*Course:\\s*(.*?)\\s*Staff:', 1), '\\s*\\(L\\d.*$', '')) AS course, trim(regexp_extract(t, '.*Staff:\\s*(.*?)\\s*Room:', 1)) AS staff,
  trim(regexp_replace(regexp_extract(t, '.*Room:\\s*(.*)$', 1), '\\s+[A-Z0-9]\\s*$', '')) AS room, 'L' || regexp_extract(t, '\\(L(\\d+)\\)', 1) AS group_label, raw AS raw_text FROM t""")
def parse_block(spark, folder):
    kind = F.get(F.array(*map(F.lit, ("Lecture", "lab", "Tutorial", "Talk"))), (F.col("p_partkey") % 4).cast("int"))
    s = lambda c: c.cast("string")
    t = F.concat(kind, F.lit(", Wks S2W"), s(F.col("p_size") % 9 + 1), F.lit("- S2W"), s(F.col("p_size") % 9 + 3), F.lit(" [="), s(F.col("p_size")), F.lit("] Course: "), F.col("p_brand"), F.lit(" (L"), s(F.col("p_partkey") % 5), F.lit(") Staff: "), F.col("p_name"), F.lit(" Room: "), F.col("p_type"), F.lit(" W"))
    return spread(load(spark, folder, "part"), "p_partkey").select("p_partkey", text.parse_block(t).alias("p")).select("p_partkey", "p.*")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Clinic' WHEN 3 THEN 'Ward' END AS type, CASE WHEN p_partkey % 4 IN (0, 3) THEN 'SUM W1-SUM W' || p_size ELSE 'S1W1-S1W' || p_size END AS weeks, CASE WHEN p_partkey % 2 = 0 THEN p_size WHEN p_size % 2 = 1 THEN 2 END AS week_count,
CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_brand END AS course, CASE WHEN p_size % 2 = 0 THEN p_name END AS staff, CASE WHEN p_size % 3 > 0 THEN 'R' || p_size END AS room FROM part""")
def parse_block_edges(spark, folder):
    """Configured types (one ends in no letter, so it is no word), summer weeks, fields said twice (the last counts, even if it is empty)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    kind = F.get(F.array(*map(F.lit, ("ward and clinic", "C++ lecture", "Lecture", "on the WARD"))), (k % 4).cast("int"))
    span = F.when((k % 4).isin(0, 3), F.concat(F.lit(" SUM W1-SUM W"), s(size))).otherwise(F.concat(F.lit(" S1W1-\n S1W"), s(size)))
    count = F.when(k % 2 == 0, F.concat(F.lit(" [="), s(size), F.lit("]"))).otherwise(" [=?]")
    course = F.concat(F.lit(" Course: old Course: "), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.col("p_brand")).otherwise(""))
    staff = F.concat(F.lit(" Staff: "), F.when(size % 2 == 0, F.concat(F.lit("gone Staff: "), "p_name", F.lit(" Wks 1-3"))).otherwise("someone Staff: [=2]"))
    room = F.concat(F.lit(" Room: "), F.when(size % 3 > 0, F.concat(F.lit("R"), s(size), F.lit(" E "))).otherwise(""))
    t = F.concat(kind, F.lit(","), span, count, course, staff, room)
    types = F.array(*map(F.lit, ("Clinic", "C++", "Ward")))
    return spread(load(spark, folder, "part"), "p_partkey").select("p_partkey", text.parse_block(t, types).alias("p")).select("p_partkey", "p.type", "p.weeks", "p.week_count", "p.course", "p.staff", "p.room")


@query(f"""WITH t AS (SELECT event_id, minute, CAST(minute // 60 AS INTEGER) AS h, CAST(minute % 60 AS INTEGER) AS m FROM {E})
SELECT event_id, minute AS minutes, minute AS minutes_ui, printf('%02d:%02d', h, m) AS clock, (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || ':' || printf('%02d', m) || CASE WHEN h >= 12 THEN ' PM' ELSE ' AM' END AS label,
printf('%02d:%02d', CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END, m) || CASE WHEN h >= 12 THEN ' PM' ELSE ' AM' END AS shown, CASE WHEN minute < 480 OR minute > 1320 THEN -1 ELSE CAST((minute - 480) // 30 AS INTEGER) END AS slot FROM t""")
def parse_time_minutes(spark, folder):
    e = _events(spark, folder).withColumn("t", F.date_format(F.col("ts").cast("timestamp"), "hh:mma"))
    m = times.minutes(F.col("t"))
    return e.select("event_id", m.alias("minutes"), times.minutes_ui(F.lower("t")).alias("minutes_ui"), times.clock(m).alias("clock"), times.clock_label(m).alias("label"), times.display_time(F.col("t")).alias("shown"), times.grid_slot(F.col("t")).alias("slot"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(upper(p_name || ' (' || p_type || ')'), '\\s+', '-', 'g'), '[^a-zA-Z0-9_-]', '', 'g') AS slug, 'Lab-' || regexp_replace(p_brand, '[^a-zA-Z0-9_-]', '', 'g') || '-0800 AM-1000 AM' || CASE WHEN p_size % 2 = 0 THEN '-L' || p_size ELSE '' END AS stream_id,
'Lab' || CASE WHEN p_size % 2 = 0 THEN '-L' || p_size ELSE '' END AS type_key FROM part""")
def slug_keys(spark, folder):
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("L"), F.col("p_size").cast("string")))
    return load(spark, folder, "part").select("p_partkey", keys.course_slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"), keys.stream_id(F.lit("laboratory"), F.col("p_brand"), F.lit("08:00 AM"), F.lit("10:00 AM"), label).alias("stream_id"), keys.type_key(F.lit("Lab"), label).alias("type_key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, folder):
    reply = F.concat(F.lit("Here it is: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return load(spark, folder, "events").select("event_id", text.parse_json(reply, "k bigint")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, folder):
    return load(spark, folder, "pages").select("page_id", text.tag_text(F.col("html"), "title").alias("title"))


@query("SELECT o_orderkey, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS class, CASE WHEN length(o_orderpriority) > 8 THEN left(o_orderpriority, 6) || '..' ELSE o_orderpriority END AS short FROM (SELECT *, (o_orderkey % 100) / 100.0 AS c FROM orders)")
def confidence_and_ellipsis(spark, folder):
    return load(spark, folder, "orders").select("o_orderkey", text.confidence_class((F.col("o_orderkey") % 100) / 100.0).alias("class"), text.shortened(F.col("o_orderpriority"), 8).alias("short"))


@query(f"""WITH d AS (SELECT user_id, lower(dayname(ts)) AS day, min(event_id) AS f FROM {E} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d)
SELECT user_id, day, round((i - 1) / n, 4) AS "left", round(i / n, 4) AS "right" FROM r""")
def derive_columns(spark, folder):
    days = _events(spark, folder).groupBy("user_id", F.date_format(F.col("ts").cast("timestamp"), "EEEE").alias("day")).agg(F.min("event_id").alias("event_id"))  # at most seven for each user
    e = days.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "day"))).alias("entries"))
    return e.select("user_id", F.explode(configs.derived_columns(F.col("entries"))).alias("c")).select("user_id", "c.*")


# -- folds ------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT user_id, day, list(struct_pack(i := event_id, s := minute) ORDER BY event_id) AS l FROM {E} WHERE event_type = 'click' GROUP BY 1, 2),
q AS (SELECT user_id, day, list(struct_pack(i := event_id, s := minute) ORDER BY event_id) AS c FROM {E} WHERE event_type = 'purchase' GROUP BY 1, 2),
j AS (SELECT user_id, day, l, c, len(l) AS n FROM r JOIN q USING (user_id, day)),
w AS (WITH RECURSIVE w AS (SELECT user_id, day, l, c, n, 1 AS k, CAST([] AS STRUCT(rule_idx BIGINT, llm_idx BIGINT, gap INTEGER)[]) AS acc FROM j
  UNION ALL SELECT user_id, day, l, c, n, k + 1, CASE WHEN b IS NULL THEN acc ELSE list_append(acc, struct_pack(rule_idx := l[k].i, llm_idx := b.i, gap := b.g)) END FROM (
    SELECT *, list_min(list_transform(list_filter(c, lambda x: abs(x.s - l[k].s) <= 90 AND NOT list_contains(list_transform(acc, lambda a: a.llm_idx), x.i)), lambda x: struct_pack(g := CAST(abs(x.s - l[k].s) AS INTEGER), i := x.i))) AS b FROM w WHERE k <= n)) SELECT * FROM w WHERE k = n + 1)
SELECT user_id, m.rule_idx AS rule_idx, m.llm_idx AS llm_idx, m.gap AS gap FROM (SELECT user_id, unnest(acc) AS m FROM w)""")
def greedy_match(spark, folder):
    e = _events(spark, folder)
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("idx"), "day", F.col("minute").alias("start"))
    return folds.greedy_pairs(side("click"), side("purchase"), ["user_id"])


@query(f"""WITH r AS (SELECT user_id, day, event_id, CAST(value AS DOUBLE) AS x0, CAST(minute % 200 AS DOUBLE) AS top FROM {E}),
g AS (SELECT user_id, day, list(struct_pack(x0 := x0, x1 := x0 + 5, top := top, bottom := top + 4) ORDER BY top, x0, event_id) AS l, count(*) AS n FROM r GROUP BY 1, 2),
w AS (WITH RECURSIVE w AS (SELECT user_id, day, l, n, 1 AS k, CAST([] AS STRUCT(x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE)[]) AS acc FROM g
  UNION ALL SELECT user_id, day, l, n, k + 1, CASE WHEN p IS NULL OR p = 0 THEN list_append(acc, l[k]) ELSE list_transform(acc, lambda c, i: CASE WHEN i = p THEN struct_pack(x0 := least(c.x0, l[k].x0), x1 := greatest(c.x1, l[k].x1), top := least(c.top, l[k].top), bottom := greatest(c.bottom, l[k].bottom)) ELSE c END) END FROM (
    SELECT *, list_position(list_transform(acc, lambda c: l[k].x0 < c.x1 + 5 AND l[k].x1 > c.x0 - 5 AND abs(l[k].top - c.bottom) < 30), true) AS p FROM w WHERE k <= n)) SELECT * FROM w WHERE k = n + 1)
SELECT user_id, day, CAST(i - 1 AS INTEGER) AS cluster_idx, acc[i].x0 AS x0, acc[i].x1 AS x1, acc[i].top AS top, acc[i].bottom AS bottom FROM (SELECT user_id, day, acc, unnest(range(1, len(acc) + 1)) AS i FROM w)""")
def box_cluster(spark, folder):
    r = _events(spark, folder).select("user_id", "day", F.col("event_id").cast("int").alias("seq"), F.col("value").cast("double").alias("x0"), (F.col("value") + 5).cast("double").alias("x1"), (F.col("minute") % 200).cast("double").alias("top"), (F.col("minute") % 200 + 4).cast("double").alias("bottom"))
    return folds.clusters(r, ["user_id", "day"])


@query(f"""WITH s AS (SELECT user_id, substr(day, 1, 7) AS month, event_type, list(struct_pack(q := event_id, d := day, s := minute, e := minute + 120) ORDER BY event_id) AS c FROM {E} GROUP BY 1, 2, 3),
g AS (SELECT user_id, month, list(c ORDER BY event_type) AS l, count(*) AS n FROM s GROUP BY 1, 2),
w AS (WITH RECURSIVE w AS (SELECT user_id, month, l, n, 1 AS k, CAST([] AS STRUCT(q BIGINT, d VARCHAR, s INTEGER, e INTEGER)[]) AS acc FROM g
  UNION ALL SELECT user_id, month, l, n, k + 1, list_append(acc, list_filter(l[k], lambda x: x.q = b.q)[1]) FROM (
    SELECT *, list_min(list_transform(l[k], lambda x: struct_pack(o := len(list_filter(acc, lambda p: p.d = x.d AND p.s < x.e AND x.s < p.e)), q := x.q))) AS b FROM w WHERE k <= n)) SELECT * FROM w WHERE k = n + 1)
SELECT user_id, month, CAST(i - 1 AS INTEGER) AS seq, CAST(acc[i].q AS VARCHAR) AS "key" FROM (SELECT user_id, month, acc, unnest(range(1, len(acc) + 1)) AS i FROM w)""")
def auto_place(spark, folder):
    e = _events(spark, folder).select("user_id", F.substring("day", 1, 7).alias("month"), "event_type", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("key"), "day", F.col("minute").alias("start"), (F.col("minute") + 120).alias("end"))
    placed = folds.place_streams(e, ["user_id", "month"], ["event_type"])
    return placed.select("user_id", "month", (F.row_number().over(Window.partitionBy("user_id", "month").orderBy("event_type")) - 1).alias("seq"), "key")
