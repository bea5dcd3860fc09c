"""Record-level work: filters, first-wins, latest state, versions, diffs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import minutes

DIFF_FIELDS = ("start_time", "end_time", "room", "staff", "activity_type")


def filter_resources(df: DataFrame, res_type: str | None = None, faculty: str | None = None, dept: str | None = None, codes: list[str] | None = None, limit: int | None = None, all_resources: bool = True, order: str = "id") -> DataFrame:
    """Conjunction of optional predicates, then a limit (0 or None: all).

    Type is equal in any case, faculty and department contain the value in any
    case, and the name contains one of the codes in any case. A type alone is no
    filter where not all resources are asked for.
    """
    if not all_resources and not (faculty or dept or codes):
        raise ValueError("give a faculty, a department or codes, or ask for all resources")
    if res_type:
        df = df.where(F.lower("type") == res_type.lower())
    for column, value in (("faculty", faculty), ("dept", dept)):
        if value:
            df = df.where(F.contains(F.lower(column), F.lit(value.lower())))
    if codes:
        df = df.where(F.exists(F.array(*map(F.lit, codes)), lambda c: F.contains(F.upper(F.col("name")), F.upper(c))))
    return df.orderBy(order).limit(limit) if limit else df


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; null keys are equal. One aggregate, so a hot key leaves a row a task before the shuffle."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(first).select("_first.*")


def latest(df: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """The value of each key with the greatest ``by``, as one aggregate."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*by)).alias(value))


def active_config(configs: DataFrame, course_code: str) -> DataFrame:
    """The active configuration of a course with the highest version."""
    return configs.where((F.col("status") == "active") & (F.upper("course_code") == course_code.upper())).orderBy(F.desc("version"), F.desc("config_id")).limit(1)


def configs(df: DataFrame, status: str | None = None, course_code: str | None = None) -> DataFrame:
    """Configurations by status and course, the latest made first; those made before times were kept come last."""
    if status:
        df = df.where(F.col("status") == status)
    if course_code:
        df = df.where(F.upper("course_code") == course_code.upper())
    return df.orderBy(F.desc_nulls_last("created_at"), "config_id")


def config_summaries(df: DataFrame) -> DataFrame:
    """What lists show of configurations."""
    return df.select("config_id", "course_code", "status", "generated_by", F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("config.confidence", F.lit(0.0)).alias("confidence"), "created_at")


def active_count(df: DataFrame) -> DataFrame:
    """One row: how many configurations there are, and how many of them are active."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"))


def activate(df: DataFrame, config_id: str) -> DataFrame:
    """A snapshot in which a configuration is active and the course's other active ones are superseded; unknown ids change nothing."""
    target = df.where(F.col("config_id") == config_id).select(F.upper("course_code").alias("_course")).distinct()
    out = df.join(target, F.upper("course_code") == F.col("_course"), "left")
    status = F.when(F.col("config_id") == config_id, F.lit("active")).when(F.col("_course").isNotNull() & (F.col("status") == "active"), F.lit("superseded")).otherwise(F.col("status"))
    return out.withColumn("status", status).select(df.columns)


def supersede(df: DataFrame, key: str, order: list[str], status: str, active: str, superseded: str) -> DataFrame:
    """Every key's latest row becomes active (rows equal in order all do); its other active rows are superseded.

    The latest is an aggregate joined back, one row for each key, so a hot key's
    rows are not sorted in one task. Rows without a key keep their status.
    """
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"))
    out = df.join(last, key, "left")
    now = F.struct(*order) == F.col("_last")
    return out.select(*(F.when(now, F.lit(active)).when((F.col(status) == active) & now.isNotNull(), F.lit(superseded)).otherwise(F.col(status)).alias(status) if c == status else F.col(c) for c in df.columns))


def cascade(keys: DataFrame, key: str, configs: DataFrame, config: str, default: Column) -> DataFrame:
    """Each key with its configuration, or the default."""
    return keys.join(configs, key, "left").withColumn(config, F.coalesce(F.col(config), default))


def fold_events(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Current state from an append-only log: the last value that is not null of each column."""
    return events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns))


def recent(df: DataFrame, at: str, id_col: str, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The latest rows, ties by id."""
    return (df if where is None else df.where(where)).orderBy(F.desc(at), id_col).limit(limit)


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, the same in every run: the smallest by md5 of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(k)


def normalise(entries: DataFrame, source: str) -> DataFrame:
    """Entries of either extractor in the common schema; other columns stay in front."""
    own = [c for c in entries.columns if c not in ("day", "start_time", "end_time", "room", "staff", "type", "activity_type", "course", "weeks", "week_count", "group_label", "raw_text", "semester")]
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    optional = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.trim(F.col(c)))
    start, end = minutes(text("start_time")), minutes(text("end_time"))
    rule = source == "rule"
    only = lambda c, kind="string": (F.col(c) if rule else F.lit(None)).cast(kind).alias(c)
    return entries.select(
        *own, text("day").alias("day"), text("start_time").alias("start_time"), text("end_time").alias("end_time"), start.alias("start_minutes"), end.alias("end_minutes"), (end - start).alias("duration_minutes"),
        optional("room").alias("room"), optional("staff").alias("staff"), F.col("type" if rule else "activity_type").alias("activity_type"), only("course"), only("weeks"), only("week_count", "int"), only("group_label"),
    )


def compared(c: Column, field: str, times_as_minutes: bool = False) -> Column:
    """How a field is compared: rooms trimmed in upper case, staff also without blanks and commas, null equal to empty for both; others as they are."""
    if field == "room":
        return F.upper(F.trim(F.coalesce(c, F.lit(""))))
    if field == "staff":
        return F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), " ,", "")
    if times_as_minutes and field in ("start_time", "end_time"):
        return minutes(c)
    return c


def field_diff(pairs: DataFrame, keys: list[str], left: str = "rule", right: str = "llm", fields: tuple[str, ...] = DIFF_FIELDS, times_as_minutes: bool = False) -> DataFrame:
    """Long form of what differs between two struct columns: keys, field, and both values.

    Times are compared as text unless times_as_minutes, which takes 01:00 PM and
    01:00PM as equal.
    """
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"{left}.{f}").cast("string").alias(left), F.col(f"{right}.{f}").cast("string").alias(right), (~compared(F.col(f"{left}.{f}"), f, times_as_minutes).eqNullSafe(compared(F.col(f"{right}.{f}"), f, times_as_minutes))).alias("differs"))
    long = pairs.select(*keys, F.explode(F.array(*map(one, fields))).alias("d"))
    return long.where("d.differs").select(*keys, "d.field", F.col(f"d.{left}"), F.col(f"d.{right}"))


def nest_differences(diff: DataFrame, keys: list[str], left: str = "rule", right: str = "llm") -> DataFrame:
    """The long form as a map from field to both values."""
    return diff.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct(left, right))))).alias("differences"))


def outer_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key: both values and same, changed, added or removed."""
    met = a.select(key, F.col(value).alias("before"), F.lit(True).alias("_a")).join(b.select(key, F.col(value).alias("after"), F.lit(True).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), F.lit("added")).when(F.col("_b").isNull(), F.lit("removed")).when(F.col("before").eqNullSafe(F.col("after")), F.lit("same")).otherwise(F.lit("changed"))
    return met.select(key, "before", "after", change.alias("change"))


def without(df: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not among those used."""
    return df.join(used.select(*keys), keys, "left_anti")


def match_rate(matched: Column, rule: Column, llm: Column) -> Column:
    return matched / F.greatest(rule, llm, F.lit(1))


def split_errors(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, failed) rows."""
    return results.where(F.col(error).isNull()), results.where(F.col(error).isNotNull())


def download_plan(resources: DataFrame, present: DataFrame, name: str = "file") -> DataFrame:
    """Each resource as download or skip, by whether its file is there."""
    have = present.select(F.col(name)).distinct().withColumn("_have", F.lit(True))
    return resources.join(have, name, "left").withColumn("action", F.when(F.col("_have"), F.lit("skip")).otherwise(F.lit("download"))).drop("_have")


def download_counters(outcomes: DataFrame) -> DataFrame:
    one = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(one("ok").alias("downloaded"), one("skip").alias("skipped"), one("fail").alias("failed"))
