"""Plan C: two extractions of the same files, record by record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import greedy_pairs
from ..operators.records import DIFF_FIELDS, field_diff, match_rate, nest_differences, without


def indexed(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries with their place within a file, from 0."""
    return entries.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def match(rule: DataFrame, llm: DataFrame, key: str = "pdf", most: int = 90) -> DataFrame:
    """key, rule_idx, llm_idx, gap of entries matched one to one; both sides carry idx."""
    side = lambda df: df.select(key, "idx", "day", F.col("start_minutes").alias("start"))
    pairs = greedy_pairs(side(rule), side(llm), [key], most)
    return pairs.select(key, *(F.col(c).cast("int").alias(c) for c in ("rule_idx", "llm_idx")), "gap")


def run(rule: DataFrame, llm: DataFrame, key: str = "pdf", most: int = 90, times_as_minutes: bool = False) -> dict[str, DataFrame]:
    """matched, only_rule, only_llm, disagreements (nested) and per-file and overall summaries.

    rule and llm are normalised entries with the file's key and idx.
    """
    pairs = match(rule, llm, key, most)
    r = rule.select(key, F.col("idx").alias("rule_idx"), F.struct("day", "course", *DIFF_FIELDS).alias("rule"))
    l = llm.select(key, F.col("idx").alias("llm_idx"), F.struct("day", *DIFF_FIELDS).alias("llm"))  # noqa: E741
    full = pairs.join(r, [key, "rule_idx"]).join(l, [key, "llm_idx"])
    diff = nest_differences(field_diff(full, [key, "rule_idx", "llm_idx"], times_as_minutes=times_as_minutes), [key, "rule_idx", "llm_idx"])
    disagreements = full.join(diff, [key, "rule_idx", "llm_idx"]).select(key, F.col("rule.day").alias("day"), F.col("rule.start_time").alias("rule_start"), F.col("llm.start_time").alias("llm_start"), F.col("gap").alias("time_diff_min"), F.col("rule.course").alias("rule_course"), "differences")
    only = lambda df, idx: without(df, pairs.withColumn("idx", F.col(idx)), [key, "idx"])
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    lasting = lambda df, name: df.where("duration_minutes > 0").groupBy(key).agg(F.sum("duration_minutes").alias(f"{name}_minutes"), F.count("*").alias(f"{name}_lasting"))
    per_file = rule.select(key).unionAll(llm.select(key)).distinct()
    names = ("rule_count", "llm_count", "matched_count", "disagreement_count")
    for df in (*map(count, (rule, llm, pairs, disagreements), names), lasting(rule, "rule"), lasting(llm, "llm")):
        per_file = per_file.join(df, key, "left")
    durations = ("rule_minutes", "rule_lasting", "llm_minutes", "llm_lasting")
    per_file = per_file.select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in (*names, *durations)))
    per_file = per_file.withColumns({"only_rule_count": F.col("rule_count") - F.col("matched_count"), "only_llm_count": F.col("llm_count") - F.col("matched_count"), "match_rate": match_rate(F.col("matched_count"), F.col("rule_count"), F.col("llm_count"))})
    mean = lambda side: F.coalesce(F.try_divide(F.sum(f"{side}_minutes"), F.sum(f"{side}_lasting")), F.lit(0.0)).alias(f"{side}_mean_duration")
    overall = per_file.agg(*(F.sum(n).alias(n) for n in (*names, "only_rule_count", "only_llm_count")), mean("rule"), mean("llm"))
    return {"matched": full, "only_rule": only(rule, "rule_idx"), "only_llm": only(llm, "llm_idx"), "disagreements": disagreements, "per_file": per_file, "overall": overall}
