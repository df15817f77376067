"""Counts and samples of a prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shorten

# How much of a question and of its SQL a preview shows.
QUESTION_CHARS = 120
SQL_CHARS = 200


def run_report(predictions: DataFrame) -> DataFrame:
    """One row: n_rows, n_ok, n_error and the mean seconds per row.

    Every try counts: a question that failed and was tried again has two rows.
    """
    errors = F.count_if(F.col("status") == "error")
    return predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - errors).alias("n_ok"),
        errors.alias("n_error"),
        F.avg("elapsed_sec").alias("avg_sec"),
    )


def preview(predictions: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows without error, with long texts shortened."""
    return (
        predictions.where(F.col("status") == "ok")
        .orderBy("index")
        .limit(max(0, n))
        .select(
            "index",
            "db_id",
            shorten(F.col("question"), QUESTION_CHARS).alias("question"),
            shorten(F.col("predicted_sql"), SQL_CHARS).alias("predicted_sql"),
        )
    )
