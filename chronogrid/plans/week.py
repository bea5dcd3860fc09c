"""Plan E: results to courses and streams, placed into a week without avoidable conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, times
from ..operators.folds import place_streams
from ..operators.overlap import conflicts
from ..operators.records import first_wins
from . import history

TYPE_ORDER = ("Lecture", "Lab", "Tutorial", "Seminar", "Workshop", "Other")


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def courses(results: DataFrame, order: str = "seq") -> DataFrame:
    """course_id, title, source_file, entries and seq of the first result of each course."""
    title = F.coalesce(_some(F.col("course_title")), _some(F.col("source_file")), F.lit("Unknown"))
    return first_wins(results.select(keys.course_slug(title).alias("course_id"), title.alias("title"), "source_file", "entries", F.col(order).alias("seq")), ["course_id"], ["seq"])


def streams(courses: DataFrame) -> DataFrame:
    """Streams of each course, the first of each id, with their place (seq) and their course's (course_seq)."""
    e = courses.select("course_id", F.col("seq").alias("course_seq"), F.posexplode("entries").alias("seq", "e"))
    kind = keys.activity(F.coalesce(F.col("e.type"), F.lit("")))
    out = e.select(
        "course_id", "course_seq", "seq", keys.stream_id(kind, F.col("e.day"), F.col("e.start_time"), F.col("e.end_time"), F.col("e.group_label")).alias("stream_id"), kind.alias("type"), keys.type_key(kind, F.col("e.group_label")).alias("type_key"),
        F.col("e.day").alias("day"), times.stored_time(F.col("e.start_time")).alias("start_time"), times.stored_time(F.col("e.end_time")).alias("end_time"),
        *(_some(F.col(f"e.{c}")).alias(c) for c in ("room", "staff", "group_label", "weeks")), F.nullif(F.col("e.week_count"), F.lit(0)).alias("week_count"),
    )
    return first_wins(out, ["course_id", "stream_id"], ["seq"])


def place(streams: DataFrame, plan: list[str]) -> DataFrame:
    """One stream per course and type, with the fewest overlaps so far, for each plan, in placing order (seq).

    A plan is placed in one sequence; plans are spread over tasks. So the columns that name a
    plan must be given. Types that are not known are placed before all others.
    """
    if not plan:
        raise ValueError("name the columns of a plan")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")), F.lit(0))
    rows = streams.select(*plan, "course_seq", rank.alias("rank"), "course_id", F.col("type").alias("stream_type"), "seq", F.col("stream_id").alias("key"), "day", times.minutes_ui(F.col("start_time")).alias("start"), times.minutes_ui(F.col("end_time")).alias("end"))
    placed = place_streams(rows, plan, ["course_seq", "rank", "course_id", "stream_type"])
    in_plan = Window.partitionBy(*plan).orderBy("course_seq", "rank", "course_id", "stream_type")
    return placed.select(*plan, (F.row_number().over(in_plan) - 1).alias("seq"), "course_id", "stream_type", F.col("key").alias("selected_stream_id"))


def placed_events(placements: DataFrame, streams: DataFrame, plan: list[str] | None = None) -> DataFrame:
    """Placements with their streams; those without one are dropped."""
    p = placements.withColumnRenamed("selected_stream_id", "stream_id")
    own = [c for c in streams.columns if c not in ("seq", "course_seq")]
    return p.join(streams.select(*own), [*(plan or []), "course_id", "stream_id"])


def placement_details(placements: DataFrame, streams: DataFrame, course_id: str, stream_type: str) -> DataFrame:
    """The stream placed for a course and type; no row if any link is missing."""
    return placed_events(placements.where((F.col("course_id") == course_id) & (F.col("stream_type") == stream_type)), streams)


def available(streams: DataFrame, course_id: str, kind: str) -> DataFrame:
    return streams.where((F.col("course_id") == course_id) & (F.col("type") == kind))


def find_conflicts(events: DataFrame, plan: list[str] | None = None) -> DataFrame:
    """Pairs of placed events of different courses that overlap on a day."""
    e = events.withColumns({"_s": times.minutes_ui(F.col("start_time")), "_e": times.minutes_ui(F.col("end_time"))})
    return conflicts(e, [*(plan or []), "day"], "_s", "_e", "seq", "course_id")


def placements_at(log: DataFrame, upto: int | None = None, plan: list[str] | None = None) -> DataFrame:
    """Placements after a log of edits (seq, action move or remove, course_id, stream_type, selected_stream_id) up to a point; see edits_in_force for undo and redo."""
    if upto is not None:
        log = log.where(F.col("seq") <= upto)
    keys = [*(plan or []), "course_id", "stream_type"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct("action", "selected_stream_id"), "seq").alias("e"))
    return last.where("e.action = 'move'").select(*keys, "e.selected_stream_id")


def edits_in_force(log: DataFrame, plan: list[str], most: int = 50, keys: tuple[str, ...] = ("course_id", "stream_type"), block_rows: int = 1000) -> DataFrame:
    """The edits of each plan's log that undo and redo have left in force, in order; see plans.history.

    The last ``most`` edits can be undone. A plan's log is replayed in blocks of ``block_rows``.
    """
    return history.in_force(history.replayed(log, plan, most, keys, block_rows), log, plan)


def undo_points(log: DataFrame, plan: list[str], most: int = 50, keys: tuple[str, ...] = ("course_id", "stream_type"), block_rows: int = 1000) -> DataFrame:
    """plan and seq of the edits that undo can still take back, the last one first (place 0)."""
    return history.undoable(history.replayed(log, plan, most, keys, block_rows), plan)
