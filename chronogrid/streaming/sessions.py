"""Calibration sessions as a stateful stream: each session's state is kept up to date as its events arrive.

The state of a session is, for each field, the value with the highest sequence number so far, the
same for each phase, and when it began and last changed. So events in any order, late within the
watermark, or met again give what the fold over the whole log gives. A session that is in progress
and has had no event for too long, by event time, is failed; an event after that goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

FIELDS = ("course_code", "status", "config_id", "confidence", "report")
STATE = "session_id string, course_code string, status string, config_id string, confidence double, report string, phases map<string,string>, created_us long, updated_us long, n_events long, timed_out boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionState(StatefulProcessor):
    """Value state and one timer for each session."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "state string")

    def _held(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"fields": {}, "phases": {}, "began": None, "changed": None, "seen": [], "n": 0, "timer": None, "late": False}

    def _row(self, key: tuple, held: dict) -> Iterator[pd.DataFrame]:
        value = {f: held["fields"].get(f, (None, None))[1] for f in FIELDS}
        if held["late"]:
            value["status"] = "failed"
        confidence = None if value["confidence"] is None else float(value["confidence"])
        row = {"session_id": key[0], **value, "confidence": confidence, "phases": json.dumps({p: s for p, (_, s) in held["phases"].items()}), "created_us": held["began"], "updated_us": held["changed"], "n_events": held["n"], "timed_out": held["late"]}
        yield pd.DataFrame([row])

    def _watch(self, held: dict) -> None:
        """One timer, as long as the session is in progress."""
        if held["timer"] is not None:
            self.handle.deleteTimer(held["timer"])
        running = held["fields"].get("status", (None, None))[1] == "in_progress" and not held["late"]
        held["timer"] = (held["changed"] + self.limit_us) // 1000 if running else None
        if running:
            self.handle.registerTimer(held["timer"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        last = held["changed"]
        for batch in rows:
            for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                seq, at = int(r["seq"]), int(r["at_us"])
                held["n"] += 1
                held["began"] = at if held["began"] is None else min(held["began"], at)
                held["changed"] = at if held["changed"] is None else max(held["changed"], at)
                for f in FIELDS:
                    if r[f] is not None and seq >= held["fields"].get(f, (-1, None))[0]:
                        held["fields"][f] = (seq, r[f])
                if r["phase"] is not None and r["phase_state"] is not None and seq >= held["phases"].get(r["phase"], (-1, None))[0]:
                    held["phases"][r["phase"]] = (seq, r["phase_state"])
        if held["changed"] != last:
            held["late"] = False
        self._watch(held)
        self.state.update((json.dumps(held),))
        yield from self._row(key, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held["timer"] is None or expiredTimerInfo.getExpiryTimeInMs() < held["timer"]:
            return
        held["timer"], held["late"] = None, True
        self.state.update((json.dumps(held),))
        yield from self._row(key, held)

    def close(self) -> None:
        """Nothing is kept open."""


def states(events: DataFrame, late: str = "1 hour", limit: str = "1 day") -> DataFrame:
    """The state of each session after each micro-batch in which it changed; events: a stream of the session log.

    The session's state store must be RocksDB (see ``running``).
    """
    spark = events.sparkSession
    limit_us = spark.sql(f"SELECT cast(INTERVAL {limit} AS interval day to second) AS i").select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.col("i"))).alias("us")).first().us
    arriving = events.where("session_id IS NOT NULL").withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    text = StructType.fromDDL(STATE.replace("map<string,string>", "string"))
    out = arriving.groupBy("session_id").transformWithStateInPandas(SessionState(limit_us), text, "Update", "EventTime")
    return out.withColumn("phases", F.from_json("phases", "map<string,string>"))


def running(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's states to a folder, over what there is, and stop; a run again goes on from the checkpoint."""
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        w = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return w.foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{table}/batch={k:09d}")).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest(table: DataFrame) -> DataFrame:
    """The last state of each session that was written."""
    names = [c for c in table.columns if c not in ("batch", "session_id")]
    last = table.groupBy("session_id").agg(F.max_by(F.struct(*names), F.struct("batch", "n_events", F.col("timed_out"))).alias("s"))
    return last.select("session_id", "s.*")
