"""Markdown reports, rendered on the driver from aggregates of a few rows.

A table that is longer than a report shows ends with the number of rows left out;
the file sinks write tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _table(header: list[str], rows: list[list]) -> list[str]:
    cell = lambda v: "_None_" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def _rows(df: DataFrame, columns: list[str], most: int) -> list[list]:
    return [list(r) for r in df.select(*columns).limit(most).collect()]


def _left_out(df: DataFrame, shown: int, most: int) -> list[str]:
    """A note of the rows that a table of at most so many rows doesn't show."""
    more = df.count() - shown if shown >= most else 0
    return [f"{more} more rows left out.", ""] if more else []


def comparison(result: dict[str, DataFrame], key: str = "pdf", failed: int = 0, most: int = 1000) -> str:
    """Comparison of two extractions: totals, a row per file, disagreements. What it says is measured."""
    o = result["overall"].first()
    files = _rows(result["per_file"].orderBy(key), [key, "rule_count", "llm_count", "matched_count", "match_rate"], most)
    out = ["# Extraction comparison", "", f"Compared: {result['per_file'].count()}; failed: {failed}.", ""]
    out += _table(["Measure", "Value"], [["Rule entries", o.rule_count], ["Model entries", o.llm_count], ["Matched", o.matched_count], ["Rule only", o.only_rule_count], ["Model only", o.only_llm_count], ["With disagreements", o.disagreement_count], ["Mean minutes, rule", o.rule_mean_duration], ["Mean minutes, model", o.llm_mean_duration]])
    out += ["## By file", "", *_table(["File", "Rule", "Model", "Matched", "Rate"], [[*f[:4], f"{100 * f[4]:.1f}%"] for f in files]), *_left_out(result["per_file"], len(files), most), "## Disagreements", ""]
    differing = result["disagreements"].limit(most).collect()
    for r in differing:
        out.append(f"- {r[key]}, {r.day}, {r.rule_start} / {r.llm_start}: " + "; ".join(f"{k}: {v[0]!r} / {v[1]!r}" for k, v in r.differences.items()))
    if more := _left_out(result["disagreements"], len(differing), most):
        out += ["", *more]
    return "\n".join(out) + "\n"


def patterns(summary: DataFrame, most: int = 100) -> str:
    """What configurations hold: days, slots, confidence."""
    rows = summary.limit(most).collect()
    out = ["# Layout patterns", ""]
    for r in rows:
        more = f", and {r.slots_more} more" if r.slots_more else ""
        out += [f"## {r.course_code}, version {r.version} ({r.status})", "", f"- Days ({r.n_days}): {r.days or '_None_'}", f"- Slots ({r.n_slots}): {r.slots_shown or '_None_'}{more}", f"- From {r.first_slot or '_None_'} to {r.last_slot or '_None_'}", f"- Confidence: {r.confidence:.2f} ({r.confidence_class})", ""]
    out += _left_out(summary, len(rows), most)
    return "\n".join(out)


def config_comparison(comparison_row) -> str:
    """Two configurations side by side, from one row of operators.configs.compare."""
    c = comparison_row
    out = ["# Configuration comparison", "", *_table(["Region", "Difference"], [[k, v] for k, v in c.region_deltas.asDict().items()]), f"Slots: {c.slot_delta:+d}", ""]
    out += _table(["Day", "Before", "After", "Change"], [[d.day, d.before and f"{d.before.left:g}-{d.before.right:g}", d.after and f"{d.after.left:g}-{d.after.right:g}", d.change] for d in c.days])
    return "\n".join([*out, "Changed: " + (", ".join(c.changed) or "nothing"), ""])


def session_summary(state, config_row=None) -> str:
    """A calibration session: status, confidence and anomalies."""
    out = [f"# Session {state.session_id}", "", f"- Course: {state.course_code}", f"- Status: {state.status}", f"- Confidence: {state.confidence if state.confidence is not None else '_None_'}", ""]
    if state.anomalies:
        out += ["## Anomalies", "", *(f"- {a}" for a in state.anomalies), ""]
    return "\n".join(out) + (patterns(config_row) if config_row is not None else "")


def audit_text(audit: dict[str, DataFrame], most: int = 50) -> str:
    """Summary, worst discrepancies, missing labels and a verdict."""
    summary = _rows(audit["summary"], ["label", "median", "least", "greatest", "deviation", "n", "status"], most)
    off = _rows(audit["discrepancies"], ["file", "page", "label", "expected_x", "actual_x", "delta"], most)
    missing = _rows(audit["missing"], ["file", "page", "missing"], most)
    out = ["# Header audit", "", *_table(["Label", "Median", "Least", "Greatest", "Deviation", "n", "Status"], summary), *_left_out(audit["summary"], len(summary), most)]
    out += ["## Discrepancies", "", *_table(["File", "Page", "Label", "Expected", "Found", "Off by"], off), *_left_out(audit["discrepancies"], len(off), most)]
    out += ["## Missing", "", *_table(["File", "Page", "Labels"], [[f, p, "; ".join(m)] for f, p, m in missing]), *_left_out(audit["missing"], len(missing), most)]
    issues = audit["verdict"].first()[0]
    return "\n".join([*out, "All consistent." if not issues else f"{issues} issues.", ""])
