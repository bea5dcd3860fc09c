"""Axes and blocks of a page: hour slots, day bands, clusters of filled boxes and their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import day_of_label
from ..functions.times import display_time
from ..schemas import BANDS, SLOTS
from ..session import meet
from .folds import cluster_boxes
from .overlap import next_lower_in

PAGE = ["file", "page"]
LABEL = r"^\d{2}:\d{2}[AP]M"
WORK_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")


def column_edges(config: Column, side: str, whole: bool = True) -> Column:
    """Left or right edges, as page fractions, of the work days that a configuration has; whole takes only days with both edges."""
    days = F.filter(F.array(*(config["day_columns"][d] for d in WORK_DAYS)), lambda c: c["left"].isNotNull() & c["right"].isNotNull() if whole else c[side].isNotNull())
    return F.transform(days, lambda c: c[side])


def with_limits(pages: DataFrame, config: str | None = None) -> DataFrame:
    """pages with the limits that filters use; a config column (struct, may be null) overrides the usual ones.

    slot_low, slot_high: band of hour labels; day_max: right limit of day labels;
    rect_left, word_left, word_right: limits of boxes and words.
    """
    if config is None:
        return pages.select(*PAGE, "width", "height", F.lit(90.0).alias("slot_low"), F.lit(115.0).alias("slot_high"), F.lit(60.0).alias("day_max"), F.lit(50.0).alias("rect_left"), F.lit(60.0).alias("word_left"), F.lit(None).cast("double").alias("word_right"))
    c = F.col(config)
    slots = F.filter(F.coalesce(c["time_slot_map"], F.array().cast("array<struct<label:string,top:double,bottom:double>>")), lambda s: s["top"].isNotNull() & s["bottom"].isNotNull())
    first = F.array_min(column_edges(c, "left", whole=False)) * F.col("width")
    left, right = F.array_min(column_edges(c, "left")) * F.col("width"), F.array_max(column_edges(c, "right")) * F.col("width")
    edge = lambda f: F.when(F.size(slots) > 0, f(F.transform(slots, lambda s: F.least(s["top"], s["bottom"]) if f is F.array_min else F.greatest(s["top"], s["bottom"]))) * F.col("height"))
    return pages.select(
        *PAGE, "width", "height", F.coalesce(edge(F.array_min), F.lit(90.0)).alias("slot_low"), F.coalesce(edge(F.array_max), F.lit(115.0)).alias("slot_high"), F.least(F.lit(60.0), first - 5).alias("day_max"),
        F.coalesce(left, F.lit(50.0)).alias("rect_left"), F.coalesce(left, F.lit(60.0)).alias("word_left"), right.alias("word_right"),
    )


def slot_rows(words: DataFrame, limits: DataFrame) -> DataFrame:
    """Hour slots as rows, labelled as 08:00 AM: each ends where the next starts, the last 50 points after its label."""
    w = meet(words, limits.select(*PAGE, "slot_low", "slot_high"), PAGE).where(F.col("top").between(F.col("slot_low"), F.col("slot_high")) & F.col("text").rlike(LABEL))
    order = Window.partitionBy(*PAGE).orderBy("x0", "seq")
    return w.select(*PAGE, F.col("x0").alias("x_start"), F.coalesce(F.lead("x0").over(order), F.col("x1") + 50).alias("x_end"), display_time(F.col("text")).alias("label"), (F.row_number().over(order) - 1).alias("idx"))


def slots(words: DataFrame, limits: DataFrame) -> DataFrame:
    """Hour slots as one array for each page that has any."""
    rows = slot_rows(words, limits)
    return rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("x_start", "x_end", "label", "idx"))).cast(SLOTS).alias("slots"))


def day_bands(words: DataFrame, limits: DataFrame) -> DataFrame:
    """Day labels on the left edge as one array of bands for each page that has any."""
    w = meet(words, limits.select(*PAGE, "day_max"), PAGE).where((F.col("x0") < F.col("day_max")) & (F.col("x1") < F.col("day_max") + 20))
    w = w.withColumn("day", day_of_label(F.col("text"))).where("day IS NOT NULL")
    return w.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(F.col("top").alias("y_top"), F.col("bottom").alias("y_bottom"), "day", "seq"))).cast(BANDS).alias("bands"))


def boxes(rects: DataFrame, limits: DataFrame, wide: float = 20) -> DataFrame:
    """Clusters of filled boxes with where each ends: keys, cluster_idx, x0, x1, top, bottom, y_bottom."""
    r = meet(rects, limits.select(*PAGE, "rect_left"), PAGE).where(F.col("fill") & (F.col("x0") > F.col("rect_left")) & (F.col("width") > wide))
    made = r.groupBy(*PAGE).agg(cluster_boxes(F.collect_list(F.struct("top", "x0", "seq", "x1", "bottom"))).alias("c"))
    ends = F.transform("c", lambda b: F.struct(*(b[n].alias(n) for n in ("first", "x0", "x1", "top", "bottom")), next_lower_in(F.col("c"), b).alias("y_bottom")))
    # outer, as Spark else infers a filter that there are boxes, and folds and ends them for it once more
    found = made.select(*PAGE, F.posexplode_outer(ends).alias("cluster_idx", "b")).where("cluster_idx IS NOT NULL")
    return found.select(*PAGE, "cluster_idx", "b.*")


def blocks(words: DataFrame, clusters: DataFrame, limits: DataFrame) -> DataFrame:
    """Clusters with the words they hold, in reading order; a word may be in several, and clusters without words vanish."""
    c = meet(clusters.select(*PAGE, "cluster_idx", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("top").alias("ctop"), "y_bottom"), limits.select(*PAGE, "word_left", "word_right"), PAGE)
    inside = (F.col("x0") >= F.col("cx0") - 5) & (F.col("x1") <= F.col("cx1") + 10) & (F.col("top") >= F.col("ctop") - 5) & (F.col("top") <= F.col("y_bottom")) & (F.col("top") < 560) & (F.col("x0") > F.col("word_left")) & (F.col("word_right").isNull() | (F.col("x1") <= F.col("word_right")))
    met = meet(words, c, PAGE).where(inside)
    return met.groupBy(*PAGE, "cluster_idx", F.col("cx0").alias("x0"), F.col("cx1").alias("x1")).agg(F.min("top").alias("y_top"), F.sort_array(F.collect_list(F.struct("top", "x0", "seq", "text"))).alias("words"))
