"""Outcome of external text recognition runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.functions.metadata import ocr_known, ocr_outcome


def triage_results(results: DataFrame) -> DataFrame:
    """Add ``outcome`` (replaced, kept, error) and whether the exit code is a documented one."""
    return results.withColumns({"outcome": ocr_outcome(F.col("code")), "known_code": ocr_known(F.col("code"))})


def triage_summary(results: DataFrame) -> DataFrame:
    return triage_results(results).groupBy("outcome", "code").agg(F.count("*").alias("n"))
