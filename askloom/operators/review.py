"""Review of generated SQL by the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import build_review_prompt
from ..functions.replies import VALID, fixed_sql, parse_verdict
from .model import BATCH_BYTES, REVIEW, Model, ModelSettings, ask_model

ROUNDS = 3


def review(
    rows: DataFrame,
    model: Model,
    rounds: int = ROUNDS,
    settings: ModelSettings = REVIEW,
    batch_size: int = 32,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Add ``sql`` and ``reviewed`` to rows with question, schema_text and predicted_sql.

    ``schema_text`` joins the documents with one newline. A row leaves the loop as
    soon as its SQL is called valid; a fixed SQL is reviewed again, even an empty one;
    anything else, a failed call included, is asked again. Rows without a predicted SQL
    are not reviewed. After the last round the SQL stays as it
    is and ``reviewed`` is false. All rounds run in one stage, with no shuffle; write
    the result before using it twice, or the model is asked again.
    """
    rows = rows.withColumn("sql", F.col("predicted_sql")).withColumn("reviewed", F.lit(False))
    for _ in range(rounds):
        prompt = build_review_prompt(F.col("schema_text"), F.col("question"), F.col("sql"))
        wanted = ~F.col("reviewed") & (F.col("predicted_sql") != "")
        rows = rows.withColumn("call", ask_model(F.when(wanted, prompt), model, settings, batch_size, batch_bytes))
        rows = rows.withColumn("verdict", parse_verdict(F.col("call.reply")))
        rows = rows.withColumn(
            "sql", F.when(F.col("reviewed"), F.col("sql")).otherwise(
                F.coalesce(fixed_sql(F.col("verdict")), F.col("sql"))
            )
        ).withColumn("reviewed", F.col("reviewed") | (F.col("verdict") == VALID))
    return rows.drop("call", "verdict")
