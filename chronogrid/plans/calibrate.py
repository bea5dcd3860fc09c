"""Plan D: calibration sessions as an append-only log of events."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import configs
from ..operators.records import fold_events
from ..schemas import SESSION_EVENT
from ..sources import providers, state

PHASES = ("extraction", "config_generation", "report")


def sessions(events: DataFrame) -> DataFrame:
    """Current state of each session: last known value of each field, and when it began and last changed."""
    fields = ["course_code", "status", "config_id", "confidence", "report", "anomalies"]
    times = events.groupBy("session_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    phases = events.where("phase IS NOT NULL").groupBy("session_id", "phase").agg(F.max_by("phase_state", "seq").alias("s")).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "s")))).alias("phases"))
    return fold_events(events, "session_id", "seq", fields).join(times, "session_id").join(phases, "session_id", "left")


def recent_sessions(events: DataFrame, course_code: str | None = None, limit: int = 20) -> DataFrame:
    """Summaries of the latest sessions, of one course (spelt exactly so) or of all."""
    s = sessions(events)
    if course_code:
        s = s.where(F.col("course_code") == course_code)
    return session_summaries(s.orderBy(F.desc("created_at"), "session_id").limit(limit))


def session_summaries(sessions: DataFrame) -> DataFrame:
    """What lists show of sessions."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return sessions.select("session_id", blank("course_code"), blank("status"), "confidence", "config_id", F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("created_at"))


class Calibration:
    """Runs the phases for one document; each step is an event, and a failure is recorded and raised again.

    Versions are claimed, so runs of one course may go side by side; replies are kept in the
    folder, so a run that is repeated asks only for what it lacks.
    """

    def __init__(self, spark: SparkSession, folder: str, provider: providers.Provider, generate=configs.generate, report=None):
        self.spark, self.folder, self.provider, self.generate, self.report = spark, folder, provider, generate, report
        self.seq = 0

    def note(self, session_id: str, **fields) -> None:
        self.seq += 1
        row = {"session_id": session_id, "seq": self.seq, "at": dt.datetime.now(dt.timezone.utc)} | fields
        schema = self.spark.createDataFrame([], SESSION_EVENT).schema
        state.append(self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema), self.folder, "session_events")

    def run(self, docs: DataFrame, course_code: str) -> str:
        session_id, phase = uuid.uuid4().hex, PHASES[0]
        self.note(session_id, course_code=course_code, status="in_progress", phase=phase, phase_state="running")
        try:
            got = self.provider_reply(docs)
            self.note(session_id, phase=phase, phase_state="completed")
            phase = PHASES[1]
            made = self.generate(got, "extraction", "layout")
            config_id = uuid.uuid4().hex
            doc = configs.config_documents(made, F.lit(config_id), F.lit(course_code), F.lit(session_id))
            state.add_version(doc, self.folder, course_code, config_id)
            doc = state.read(self.spark, self.folder, "course_configs").where(F.col("config_id") == config_id)
            row = doc.first()
            self.note(session_id, phase=phase, phase_state="completed", config_id=row.config_id, confidence=float(row.config.confidence))
            phase = PHASES[2]
            text = self.report(configs.summary(doc)) if self.report else None
            self.note(session_id, status="completed", phase=phase, phase_state="completed", report=text)
        except Exception as error:
            self.note(session_id, status="failed", phase=phase, phase_state=f"failed: {error}")
            raise
        return session_id

    def provider_reply(self, docs: DataFrame) -> DataFrame:
        """Extraction and layout of the documents; a document without a reply is an error."""
        got = providers.extract(docs, self.provider, with_config=True, store=f"{self.folder}/replies")
        failed = got.where("error IS NOT NULL").select("error").first()
        if failed:
            raise RuntimeError(failed.error)
        return got
