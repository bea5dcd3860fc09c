"""Plan A: pages of words and boxes to class records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_text, is_semester, parse_block
from ..operators import layout
from ..operators.nearest import day_at, range_labels
from ..operators.overlap import same_line
from ..operators.records import first_wins
from ..session import meet


def metadata(words: DataFrame) -> DataFrame:
    """file, semester (the last such word of the first page that has one) and course_title (the last title line up to that page)."""
    marked = words.where(is_semester(F.col("text"))).select("file", "page", "seq", "text")
    first = marked.groupBy("file").agg(F.min("page").alias("p0"))
    semester = meet(marked, first, ["file"]).where("page = p0").groupBy("file").agg(F.max_by("text", "seq").alias("semester"))
    titles = meet(same_line(words, layout.PAGE, "timetable"), first, ["file"], "left").where("p0 IS NULL OR page <= p0")
    title = titles.groupBy("file").agg(F.max_by("line", F.struct("page", "anchor_seq")).alias("course_title"))
    return meet(meet(words.select("file").distinct(), semester, ["file"], "left"), title, ["file"], "left")


def entries(words: DataFrame, rects: DataFrame, pages: DataFrame, config: str | None = None) -> DataFrame:
    """One row per class: file, page, cluster_idx and the fields of an entry.

    pages: file, page, width, height and, if named, a config struct. All joins are
    on (file, page); pages without hour labels give nothing. Of rows with the same
    day, times and course in a file the first stays.
    """
    limits = layout.with_limits(pages, config)
    slots = layout.slots(words, limits)
    bands = layout.day_bands(words, limits)
    found = meet(meet(layout.blocks(words, layout.boxes(rects, limits), limits), slots, layout.PAGE), bands, layout.PAGE, "left")
    types = None
    if config:
        found = meet(found, pages.select(*layout.PAGE, F.col(config)["text_patterns"]["activity_types"].alias("_types")), layout.PAGE, "left")
        types = F.col("_types")
    times = range_labels(F.col("x0"), F.col("x1"), F.col("slots"))
    out = found.select(*layout.PAGE, "cluster_idx", day_at(F.col("y_top"), F.col("bands")).alias("day"), times.alias("t"), parse_block(block_text(F.col("words")), types).alias("p"))
    out = out.select(*layout.PAGE, "cluster_idx", "day", F.col("t.start").alias("start_time"), F.col("t.end").alias("end_time"), "p.*")
    return first_wins(out, ["file", "day", "start_time", "end_time", "course"], ["page", "cluster_idx"])


def results(words: DataFrame, rects: DataFrame, pages: DataFrame, config: str | None = None) -> DataFrame:
    """One row per file with its entries nested, in order of page and block."""
    fields = ("day", "start_time", "end_time", "type", "weeks", "week_count", "course", "staff", "room", "group_label", "raw_text")
    nested = entries(words, rects, pages, config).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "cluster_idx", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("entries"))
    out = meet(metadata(words), nested, ["file"], "left")
    return out.select(F.col("file").alias("source_file"), "semester", "course_title", F.coalesce("entries", F.array().cast(nested.schema["entries"].dataType)).alias("entries"))
