"""Undo and redo over logs of edits, replayed in blocks side by side.

A plan's log has moves and removals of placements, automatic placings, undo and redo. An edit
ends what could be redone; undo takes back one of the last ``most`` edits; undo or redo with
nothing to take does nothing, and so does the removal of a placement that is not there, which
is no edit. An automatic placing is one edit, after which just what it names is placed.

What a log has done so far is a small state: the placements below the last ``most`` edits,
these edits, and at most as many undone ones. So a log, however long, is cut into blocks:

1. Blocks are cut from the log sorted over the whole table, and written once.
2. Each block gets a guess of the state before it: placements by the last edit of each, as if
   nothing were undone; all blocks are replayed side by side.
3. A block whose state was not what the block before it has left is replayed from that. This
   repeats until every block began with what the one before left, which makes the result that
   of one replay in order, whatever was guessed. The first block is right from the start, and
   each round makes at least one more right; most are after the second.

What undo cannot reach any more is given out by the block that finds so, and is not kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import folded
from ..session import stored

EMPTY = json.dumps([[], [], []])


def replay(state: str, events: list[tuple], most: int) -> tuple[str, list[int]]:
    """The state after events (seq, action, key, placed) and the edits that undo can no longer reach.

    A state is JSON: keys placed below the edits, the edits (seq, action, key, placed), the undone ones.
    """
    placed, done, undone = json.loads(state)
    base = set(placed)
    settled: list[int] = []

    def there(key: str) -> bool:
        for _, action, k, named in reversed(done):
            if action == "auto":
                return key in named
            if k == key:
                return action == "move"
        return key in base

    for seq, action, key, named in events:
        if action == "undo":
            if done:
                undone.append(done.pop())
        elif action == "redo":
            if undone:
                done.append(undone.pop())
        elif action != "remove" or there(key):
            done.append([seq, action, key, sorted(named or []) if action == "auto" else None])
            undone = []
            if len(done) > most:
                old, what, k, all_named = done.pop(0)
                settled.append(old)
                if what == "auto":
                    base = set(all_named)
                else:
                    (base.add if what == "move" else base.discard)(k)
    return json.dumps([sorted(base), done, undone]), settled


def _blocks(log: DataFrame, plan: list[str], keys: tuple[str, ...], block_rows: int) -> DataFrame:
    """plan, first (order of blocks), events (array of seq, action, key, placed)."""
    named = F.col("placed") if "placed" in log.columns else F.lit(None).cast("array<string>")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    key = F.to_json(F.array(*parts))
    event = log.select(*plan, F.col("seq").cast("long").alias("seq"), "action", key.alias("key"), named.alias("placed"))
    runs = stored(event.repartitionByRange(*plan, "seq").sortWithinPartitions(*plan, "seq").withColumn("at", F.monotonically_increasing_id()), "edits")
    cut = [*(F.col(c) for c in plan), F.expr(f"at div {block_rows}").alias("block")]  # the id's upper bits name the run
    made = runs.groupBy(*cut).agg(F.min("seq").alias("first"), F.sort_array(F.collect_list(F.struct("seq", "action", "key", "placed"))).alias("events"))
    return stored(made.drop("block"), "edit-blocks")


def _guessed(blocks: DataFrame, plan: list[str]) -> DataFrame:
    """plan, first, state: placements by the last edit of each in the blocks before."""
    n = len(plan)

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        placed: set[str] = set()
        for row in rows:
            yield *key, row[n], json.dumps([sorted(placed), [], []])
            for _, action, k, named in (e.values() for e in row[n + 1]):
                if action == "auto":
                    placed = set(named or [])
                elif action == "move":
                    placed.add(k)
                elif action == "remove":
                    placed.discard(k)

    last = F.expr("filter(events, (e, i) -> e.action = 'auto' OR e.action IN ('move', 'remove') AND NOT exists(slice(events, i + 2, size(events)), x -> x.action IN ('move', 'remove') AND x.key = e.key))")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return folded(blocks.select(*plan, "first", last.alias("events")), plan, ["first"], fold, ", ".join([*(f"`{c}` {kinds[c]}" for c in plan), "first long", "state string"]))


def _run(blocks: DataFrame, plan: list[str], most: int) -> DataFrame:
    """Blocks with their state replayed: plan, first, state, after, settled."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    by = [*plan, "first"]

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            after, settled = replay(row[-2], [tuple(e.values()) for e in row[-1]], most)
            yield *key, row[-2], after, settled

    return folded(blocks.select(*by, "state", "events"), by, [], fold, ", ".join([*(f"`{c}` {kinds[c]}" for c in plan), "first long", "state string", "after string", "settled array<bigint>"]))


def replayed(log: DataFrame, plan: list[str], most: int = 50, keys: tuple[str, ...] = ("course_id", "stream_type"), block_rows: int = 1000) -> DataFrame:
    """plan, first, state, after and settled of every block, each begun with what the one before left.

    log: plan, seq, action (move, remove, auto, undo, redo), the columns that name a placement and,
    with auto, ``placed``: the JSON arrays of those that it places. seq is unique within a plan.
    """
    by = [*plan, "first"]
    blocks = _blocks(log, plan, keys, block_rows)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]

    def begun(states: DataFrame) -> DataFrame:
        met = blocks.alias("b").join(states.alias("s"), same("b", "s"))
        return met.select(*(F.col(f"b.{c}") for c in by), F.col("s.state").alias("state"), F.col("b.events").alias("events"))

    done = stored(_run(begun(_guessed(blocks, plan)), plan, most), "edits-replayed")
    left = F.coalesce(F.lag("after").over(Window.partitionBy(*plan).orderBy("first")), F.lit(EMPTY))
    while True:
        wrong = stored(done.withColumn("left", left).where("state <> left").select(*by, F.col("left").alias("state")), "edits-wrong")
        if wrong.isEmpty():
            return done
        right = done.alias("d").join(wrong.alias("w"), same("d", "w"), "left_anti")
        done = stored(right.unionByName(_run(begun(wrong), plan, most)), "edits-replayed")


def _last(done: DataFrame, plan: list[str]) -> DataFrame:
    """plan, edits: those that undo can take back at the end, in order."""
    final = done.groupBy(*plan).agg(F.max_by("after", "first").alias("after"))
    return final.select(*plan, F.expr("transform(from_json(get_json_object(after, '$[1]'), 'array<array<string>>'), e -> cast(e[0] as long))").alias("edits"))


def in_force(done: DataFrame, log: DataFrame, plan: list[str]) -> DataFrame:
    """The rows of the log that are edits in force."""
    settled = done.select(*plan, F.explode("settled").alias("seq"))
    kept = settled.unionByName(_last(done, plan).select(*plan, F.explode("edits").alias("seq")))
    rows = log.withColumn("seq", F.col("seq").cast("long"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*plan, "seq"]]
    return rows.alias("l").join(kept.alias("k"), on, "left_semi")


def undoable(done: DataFrame, plan: list[str]) -> DataFrame:
    """plan, place (0 is what undo takes first), seq."""
    return _last(done, plan).select(*plan, F.posexplode(F.reverse("edits")).alias("place", "seq"))
