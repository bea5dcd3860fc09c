"""Order-dependent folds: clusters, one-to-one matching, placing.

Each has a form over an array in one row, a Catalyst aggregate, and one over rows that
first cuts what is independent apart, or streams a sequence row by row, so that no page,
document or plan has to fit a row.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import folded

BOX = "array<struct<first:struct<top:double,x0:double,seq:int>,x0:double,x1:double,top:double,bottom:double>>"


def cluster_boxes(rects: Column, slack: float = 5, near: float = 30) -> Column:
    """First-fit clusters of rectangles in (top, x0) order.

    A rectangle joins the first cluster that it overlaps in x (within slack) and
    whose bottom is less than ``near`` from its top, and grows it; else it opens a
    cluster, whose ``first`` it is. rects: array of structs with top, x0, seq, x1, bottom.
    """
    ordered = F.array_sort(F.transform(rects, lambda r: F.struct(*(r[c].cast("double" if c != "seq" else "int").alias(c) for c in ("top", "x0", "seq", "x1", "bottom")))))

    def step(acc: Column, r: Column) -> Column:
        fits = F.transform(acc, lambda c: (r["x0"] < c["x1"] + slack) & (r["x1"] > c["x0"] - slack) & (F.abs(r["top"] - c["bottom"]) < near))
        at = F.array_position(fits, True)
        first = F.struct(r["top"].alias("top"), r["x0"].alias("x0"), r["seq"].alias("seq"))
        own = F.array(F.struct(first.alias("first"), r["x0"].alias("x0"), r["x1"].alias("x1"), r["top"].alias("top"), r["bottom"].alias("bottom")))
        grown = F.transform(acc, lambda c, i: F.when(i + 1 == at, F.struct(c["first"].alias("first"), F.least(c["x0"], r["x0"]).alias("x0"), F.greatest(c["x1"], r["x1"]).alias("x1"), F.least(c["top"], r["top"]).alias("top"), F.greatest(c["bottom"], r["bottom"]).alias("bottom"))).otherwise(c))
        return F.when(at > 0, grown).otherwise(F.concat(acc, own))

    return F.aggregate(ordered, F.array().cast(BOX), step)


def greedy_match(rule: Column, llm: Column, most: int = 90) -> Column:
    """Pairs (rule_idx, llm_idx) by day and nearest start, each llm entry once, rule entries in order.

    Both: arrays of structs (idx, day, start). Ties go to the lowest llm index;
    a gap over ``most`` minutes is no match.
    """
    pair = "array<struct<rule_idx:int,llm_idx:int,gap:int>>"
    order = F.array_sort(F.transform(rule, lambda r: F.struct(r["idx"].alias("idx"), r["day"].alias("day"), r["start"].alias("start"))))

    def step(acc: Column, r: Column) -> Column:
        free = F.filter(llm, lambda x: (x["day"] == r["day"]) & (F.abs(x["start"] - r["start"]) <= most) & ~F.exists(acc, lambda a: a["llm_idx"] == x["idx"]))
        best = F.array_min(F.transform(free, lambda x: F.struct(F.abs(x["start"] - r["start"]).cast("int").alias("gap"), x["idx"].cast("int").alias("idx"))))
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(r["idx"].cast("int").alias("rule_idx"), best["idx"].alias("llm_idx"), best["gap"].alias("gap")))))

    return F.aggregate(order, F.array().cast(pair), step)


def auto_place(groups: Column) -> Column:
    """The stream of each group that overlaps fewest of those placed before; ties go to the first.

    groups: array of structs (seq, streams: array of structs (seq, key, day,
    start, end)) in placement order; the result is an array of structs (seq, key,
    day, start, end).
    """
    placed = "array<struct<seq:int,key:string,day:string,start:int,end:int>>"
    ordered = F.array_sort(groups)

    def step(acc: Column, g: Column) -> Column:
        scored = F.transform(
            g["streams"],
            lambda s: F.struct(
                F.size(F.filter(acc, lambda p: (p["day"] == s["day"]) & (p["start"] < s["end"]) & (s["start"] < p["end"]))).alias("score"),
                s["seq"].cast("int").alias("sseq"), s["key"].alias("key"), s["day"].alias("day"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"),
            ),
        )
        best = F.array_min(scored)
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(g["seq"].cast("int").alias("seq"), best["key"].alias("key"), best["day"].alias("day"), best["start"].alias("start"), best["end"].alias("end")))))

    return F.aggregate(ordered, F.array().cast(placed), step)


def islands(rects: DataFrame, keys: list[str], slack: float = 5, near: float = 30) -> DataFrame:
    """rects with island and part: only those that share both can share a cluster.

    Sorted by x0, a page falls apart where a rectangle begins slack beyond all before it; an
    island, sorted by top, where one begins near beyond the lowest bottom before it.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("x0", "x1", "seq")
    # each comparison as the fold makes it, as a sum and a difference are rounded apart: both must keep the rectangles asunder
    right = F.max("x1").over(before(across))
    apart = (F.col("x0") >= right + slack) & (right <= F.col("x0") - slack)
    out = rects.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("island", F.sum("_new").over(across))
    down = Window.partitionBy(*keys, "island").orderBy("top", "x0", "seq")
    below = F.col("top") - F.max("bottom").over(before(down)) >= near
    return out.withColumn("_new", F.coalesce(below, F.lit(False)).cast("int")).withColumn("part", F.sum("_new").over(down)).drop("_new")


def clusters(rects: DataFrame, keys: list[str] | None = None, slack: float = 5, near: float = 30) -> DataFrame:
    """One row per cluster: keys, cluster_idx (creation order), x0, x1, top, bottom; each independent part of a page is folded for itself."""
    keys = keys or ["file", "page"]
    parts = islands(rects, keys, slack, near).groupBy(*keys, "island", "part").agg(cluster_boxes(F.collect_list(F.struct("top", "x0", "seq", "x1", "bottom")), slack, near).alias("c"))
    made = parts.select(*keys, F.explode("c").alias("b")).select(*keys, "b.*")
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return made.withColumn("cluster_idx", idx).select(*keys, "cluster_idx", "x0", "x1", "top", "bottom")


class Free:
    """Entries by start that are still free; the nearest one to a start is found by next-free pointers."""

    def __init__(self, entries: list[tuple[int, int]]):
        """entries: (start, idx), idx ascending within a start."""
        self.waiting: dict[int, list[int]] = {}
        for start, idx in entries:
            self.waiting.setdefault(start, []).append(idx)
        for same in self.waiting.values():
            same.sort(reverse=True)
        self.starts = sorted(self.waiting)
        n = len(self.starts)
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # place k of down is start k - 1

    @staticmethod
    def _find(to: list[int], k: int) -> int:
        root = k
        while to[root] != root:
            root = to[root]
        while to[k] != root:
            to[k], k = root, to[k]
        return root

    def take(self, start: int, most: int) -> tuple[int, int] | None:
        """(gap, idx) of the nearest free entry within most, the lowest idx of equally near ones, which is free no more."""
        at = bisect.bisect_left(self.starts, start)
        right, left = self._find(self.up, at), self._find(self.down, at) - 1
        near = [(abs(self.starts[k] - start), self.waiting[self.starts[k]][-1], k) for k in (left, right) if 0 <= k < len(self.starts)]
        if not near or min(near)[0] > most:
            return None
        gap, idx, k = min(near)
        same = self.waiting[self.starts[k]]
        same.pop()
        if not same:
            self.up[k], self.down[k + 1] = k + 1, k
        return gap, idx


def greedy_pairs(rule: DataFrame, llm: DataFrame, keys: list[str], most: int = 90) -> DataFrame:
    """keys, rule_idx, llm_idx, gap: as greedy_match, over entries as rows (keys, idx, day, start).

    A day falls apart where no two neighbouring starts are within most of each other; such a
    component is matched for itself, in a time near its size. Entries without a key, a day or a start match none.
    """
    cols = [*keys, F.col("idx").cast("long").alias("idx"), "day", F.col("start").cast("long").alias("start")]
    both = llm.select(*cols, F.lit(0).alias("side")).unionAll(rule.select(*cols, F.lit(1).alias("side"))).dropna()
    in_day = Window.partitionBy(*keys, "day").orderBy("start", "side", "idx")
    far = (F.col("start") - F.lag("start").over(in_day) > most).cast("int")
    parts = both.withColumn("_new", F.coalesce(far, F.lit(0))).withColumn("component", F.sum("_new").over(in_day)).drop("_new")
    n = len(keys)

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        free: Free | None = None
        entries: list[tuple[int, int]] = []
        for row in rows:
            idx, start, side = row[n], row[n + 2], row[n + 3]
            if side == 0:
                entries.append((start, idx))
            elif entries:
                free = free or Free(entries)
                got = free.take(start, most)
                if got:
                    yield *key[:n], idx, got[1], got[0]

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rule_idx long, llm_idx long, gap int"])
    return folded(parts, [*keys, "day", "component"], ["side", "idx"], fold, schema)


class Occupancy:
    """How many placed intervals of a day overlap another, from counts of starts and ends by minute."""

    MINUTES = 4096

    def __init__(self):
        self.starts, self.ends = [0] * (self.MINUTES + 1), [0] * (self.MINUTES + 1)
        self.empty: Counter[tuple[int, int]] = Counter()  # placed intervals that end before they begin
        self.all: Counter[tuple[int, int]] = Counter()

    @staticmethod
    def _add(tree: list[int], minute: int) -> None:
        k = minute + 1
        while k < len(tree):
            tree[k] += 1
            k += k & -k

    @staticmethod
    def _upto(tree: list[int], minute: int) -> int:
        """Count below a minute."""
        k, out = minute, 0
        while k > 0:
            out += tree[k]
            k -= k & -k
        return out

    def add(self, start: int, end: int) -> None:
        if not (0 <= start < self.MINUTES and 0 <= end < self.MINUTES):
            raise ValueError(f"minutes of a day from 0 to {self.MINUTES - 1}, not {start} and {end}")
        self.all[start, end] += 1
        if end <= start:
            self.empty[start, end] += 1
        else:
            self._add(self.starts, start)
            self._add(self.ends, end)

    def overlaps(self, start: int, end: int) -> int:
        """Placed intervals p with p.start < end and start < p.end."""
        if end <= start:
            return sum(n for (s, e), n in self.all.items() if s < end and start < e)
        most = self.MINUTES
        begun, over = self._upto(self.starts, min(max(end, 0), most)), self._upto(self.ends, min(max(start + 1, 0), most))
        return begun - over + sum(n for (s, e), n in self.empty.items() if s < end and start < e)


def place_streams(streams: DataFrame, plan: list[str], group: list[str]) -> DataFrame:
    """plan, group, key, day, start, end of the stream of each group that overlaps fewest of those placed before; ties go to the first.

    streams: plan, group (in whose order groups are placed), seq, key, day, start, end. A plan is
    one sequence, read row by row; what is kept of it is counts by minute of each day.
    """
    cols = [*plan, *group, "seq", "key", "day", "start", "end"]
    rows = streams.select(*plan, *group, "seq", "key", "day", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    a, b = len(plan), len(plan) + len(group)

    def fold(key: tuple, members: Iterator[tuple]) -> Iterator[tuple]:
        days: dict[str | None, Occupancy] = {}
        for which, options in itertools.groupby(members, key=lambda r: r[a:b]):
            best = None
            for row in options:
                *_, name, day, start, end = row
                held = days.get(day)
                score = held.overlaps(start, end) if held and day is not None and start is not None and end is not None else 0
                if best is None or score < best[0]:
                    best = (score, name, day, start, end)
            _, name, day, start, end = best
            if start is not None and end is not None:
                days.setdefault(day, Occupancy()).add(start, end)
            yield *key, *which, name, day, start, end

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return folded(rows, plan, [*group, "seq"], fold, ", ".join(f"`{c}` {kinds[c]}" for c in cols if c != "seq"))
