"""Plan B: are hour labels where they should be, and are all there?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import audit


def run(words: DataFrame, pages: DataFrame, errors: DataFrame | None = None, tolerance: float = audit.TOLERANCE) -> dict[str, DataFrame]:
    """headers, summary, discrepancies, missing and the count of issues, each a DataFrame.

    Pages read before a file failed count towards the medians and the spread, as they are in words;
    discrepancies and missing labels are those of files without an error.
    """
    spark = words.sparkSession
    headers = audit.header_words(words)
    failed = errors.select("file").distinct() if errors is not None else None
    whole = (lambda df: df.join(failed, "file", "left_anti")) if failed is not None else (lambda df: df)
    out = {"headers": headers, "summary": audit.spread(headers, audit.expected_labels(spark), "label", "x0", tolerance).orderBy("idx"), "discrepancies": audit.discrepancies(headers, tolerance, whole), "missing": audit.missing_headers(whole(pages), headers)}
    tables = [out["discrepancies"], out["missing"], *([errors] if errors is not None else [])]
    return out | {"verdict": audit.verdict(*tables)}
