"""Nearest-key and offset as-of look-ups.

Two forms each: against an array column (few slots or bands per page, carried
along), and as a join of two tables that scales with neither side in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..functions.values import bound

BAND_OFFSET = 50.0


def nearest_slot(x: Column, slots: Column) -> Column:
    """The slot struct (x_start, x_end, label, idx) whose start is nearest to x; ties go to the smallest idx; null without slots.

    Only distances and places are compared; the slot itself is taken once.
    """
    ranked = F.transform(slots, lambda s, i: F.struct(F.abs(x - s["x_start"]).alias("d"), s["idx"].alias("idx"), i.alias("i")))
    return F.get(slots, F.array_min(ranked)["i"])


def nearest_label(x: Column, slots: Column) -> Column:
    return F.coalesce(nearest_slot(x, slots)["label"], F.lit("?"))


def range_labels(x0: Column, x1: Column, slots: Column) -> Column:
    """Struct of start and end label of a horizontal extent."""
    return F.struct(nearest_label(x0, slots).alias("start"), nearest_label(x1, slots).alias("end"))


def range_slots(x0: Column, x1: Column, slots: Column) -> Column:
    """As range_labels, with the slots themselves."""
    return F.struct(nearest_label(x0, slots).alias("start"), nearest_label(x1, slots).alias("end"), nearest_slot(x0, slots).alias("start_slot"), nearest_slot(x1, slots).alias("end_slot"))


def day_at(y: Column, bands: Column, offset: float = BAND_OFFSET) -> Column:
    """Day of the last band that starts at or above y + offset, else of the first band, else Unknown.

    bands: array of structs (y_top, y_bottom, day, seq).
    """
    ordered = F.array_sort(F.transform(bands, lambda b: F.struct(b["y_top"].alias("y"), b["seq"].alias("seq"), b["day"].alias("day"))))
    last = lambda bs, limit: F.try_element_at(F.filter(bs, lambda b: b["y"] <= limit), F.lit(-1))
    day = bound(F.struct(ordered.alias("bands"), (y + offset).alias("limit")), lambda v: F.coalesce(last(v["bands"], v["limit"])["day"], F.get(v["bands"], F.lit(0))["day"]))
    return F.coalesce(day, F.lit("Unknown"))


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], x: str, cell: float) -> DataFrame:
    """Each row of left, as a struct, with its nearest row of right (_at, _tie, _id) at most a cell away as _best (d, t, id), or null.

    Both sides are dealt by keys and cells of that width, and sorted there: the nearest row
    is the last at or before x or the first at or after it. Of equal places one row stays,
    and the ends of a cell also stand in the next two (two, as a place just under a cell's
    edge may be rounded over it), so a row meets two others and no pairs are made, however
    many lie within a cell, and a hot key is spread over its cells.
    """
    place = lambda c: F.floor(F.col(c) / cell).cast("long")
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    r = right.where(finite("_at")).dropna(subset=keys).groupBy(*keys, "_at").agg(F.min(F.struct("_tie", "_id")).alias("_m"))
    r = r.select(*keys, place("_at").alias("_cell"), F.struct("_at", F.col("_m._tie").alias("_tie"), F.col("_m._id").alias("_id")).alias("_r"))
    ends = r.groupBy(*keys, "_cell").agg(F.min("_r").alias("_low"), F.max("_r").alias("_high"))
    away = lambda end, steps: ends.select(*keys, F.explode(F.array(*(F.col("_cell") + k for k in steps))).alias("_cell"), F.col(end).alias("_r"))
    r = r.unionByName(away("_high", (1, 2))).unionByName(away("_low", (-1, -2)))
    # rows without a place have no cell: they are dealt anyhow, and sorted first
    known = F.when(finite(x), F.col(x))
    plain = [f.name for f in left.schema if isinstance(f.dataType, AtomicType)]
    l = left.select(*keys, F.struct(*left.columns).alias("_left"), known.alias("_x"), F.xxhash64(*plain).alias("_any")).withColumn("_cell", F.coalesce(place("_x"), F.col("_any") % 100_000)).drop("_any")  # noqa: E741
    both = l.withColumn("_side", F.lit(1)).unionByName(r.withColumns({"_x": F.col("_r._at"), "_side": F.lit(0)}), allowMissingColumns=True)
    upto = lambda order: Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_before", F.last("_r", ignorenulls=True).over(upto(["_x", "_side"]))).withColumn("_after", F.last("_r", ignorenulls=True).over(upto([F.desc("_x"), "_side"])))

    def candidate(side: str) -> Column:
        gap = F.abs(F.col("_x") - F.col(f"{side}._at"))
        return F.when(gap <= cell, F.struct(gap.alias("d"), F.col(f"{side}._tie").alias("t"), F.col(f"{side}._id").alias("id")))

    return seen.where("_side = 1").select("_left", F.array_min(F.array(candidate("_before"), candidate("_after"))).alias("_best"))


def nearest_in_table(left: DataFrame, x: str, points: DataFrame, at: str, label: str, cell: float, tie: str | None = None) -> DataFrame:
    """left with nearest_label and nearest_distance, among points that are at most one cell away; null where there is none."""
    p = points.select(F.col(at).alias("_at"), F.col(label).alias("_id"), F.col(tie or at).alias("_tie"))
    return _nearest(left, p, [], x, cell).select("_left.*", F.col("_best.id").alias("nearest_label"), F.col("_best.d").alias("nearest_distance"))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, most: float, right_id: str) -> DataFrame:
    """For each left row the id of the right row of the same keys nearest in ``at``, at most ``most`` away, and its distance; ties to the smallest id.

    Both are null where there is none. Not exclusive: a right row may serve several
    left rows.
    """
    r = right.select(*keys, F.col(right_at).alias("_at"), F.col(right_id).alias("_id"), F.col(right_id).alias("_tie"))
    return _nearest(left, r, keys, left_at, most).select("_left.*", F.col("_best.id").alias(right_id), F.col("_best.d").alias("distance"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, bucket: float, offset: float = 0, default_first: bool = False) -> DataFrame:
    """left with the value of the last right row of its keys at or before ``left_at + offset``.

    One union and one window over the keys and buckets of ``at`` of the given width, so
    a hot key is not one task's sort; a value is carried into a bucket from the last one
    before that has any, by a window over one row for each key and bucket.
    default_first takes the key's first right row where none is early enough.
    """
    l = left.select("*", (F.col(left_at) + offset).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v")).where("_at IS NOT NULL")
    place = F.floor(F.col("_at") / bucket)
    both, r, parts = l.unionByName(r, allowMissingColumns=True).withColumn("_b", place), r.withColumn("_b", place), [*keys, "_b"]
    upto = Window.partitionBy(*parts).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1")
    of = r.where("_v IS NOT NULL").groupBy(*parts).agg(F.max_by("_v", "_at").alias("_latest"), F.min_by("_v", "_at").alias("_first"), F.min("_at").alias("_from"))
    same = lambda d, names: d.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *names)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    places = both.select(*parts).distinct().join(of.select(*(F.col(k).alias(f"_p{i}") for i, k in enumerate(parts)), "_latest"), [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(parts)], "left")
    carried = same(places.withColumn("_carried", F.last("_latest", ignorenulls=True).over(before)), [F.col("_b").alias("_kb"), "_carried"])
    out = out.join(carried, [*(out[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)), out["_b"] == carried["_kb"]], "left")
    found = F.coalesce("_last", "_carried")
    if default_first:
        firsts = of.groupBy(*keys).agg(F.min_by("_first", "_from").alias("_first")).select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)), "_first")
        out = out.join(firsts, [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)], "left")
        found = F.coalesce("_last", "_carried", "_first")
    return out.select(*left.columns, found.alias(value))
