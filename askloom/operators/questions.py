"""The steps between a question set and its prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..storage import written
from .joins import BROADCAST_LIMIT_BYTES, lookup_join

NO_INDEX = "Missing index in sample."

# Error texts of rows that cannot be tried.
NO_DB_ID = "Missing db_id in sample."
NO_QUESTION = "Missing question in sample."
NO_SCHEMA_FILE = "Schema SQL not found for db_id='{db_id}'"
NO_SCHEMA = "No schema available to generate SQL"
NOTHING_SELECTED = "No rows selected. Check the start index and the limit."


def coerce_fields(samples: DataFrame) -> DataFrame:
    """(index, db_id, question, gold_sql) with missing texts empty and all texts stripped."""

    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(name).cast("string"), F.lit("")))

    return samples.select(
        F.col("index").cast("long").alias("index"),
        text("db_id").alias("db_id"),
        text("question").alias("question"),
        text("query").alias("gold_sql"),
    )


def slice_questions(questions: DataFrame, start: int = 0, limit: int = 0) -> DataFrame:
    """Rows whose index lies in [start, start + limit); no limit if it is 0 or less.

    A filter on the index, so it is pushed to the scan and needs no order. Rows without a
    usable index lie in no slice; where nothing is cut off they stay, to be reported.
    """
    start = max(0, start)
    if start == 0 and limit <= 0:
        return questions
    chosen = questions.where(F.col("index") >= start)
    return chosen if limit <= 0 else chosen.where(F.col("index") < start + limit)


def require_rows(questions: DataFrame) -> DataFrame:
    if questions.isEmpty():
        raise ValueError(NOTHING_SELECTED)
    return questions


def resume_anti_join(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions whose index is not among the finished ones.

    One without an index cannot be known again, so every run reports it.
    """
    return questions.join(done.select("index"), "index", "left_anti")


def distinct_databases(questions: DataFrame) -> DataFrame:
    """The databases that a set asks about; schema work is done once for each."""
    return questions.where(F.col("db_id") != "").select("db_id").distinct()


def attach_schema(
    questions: DataFrame, schema_by_db: DataFrame, broadcast_limit: int = BROADCAST_LIMIT_BYTES, stored: bool = False
) -> DataFrame:
    """Add ``schema_text`` and ``has_schema_file`` to each question.

    ``schema_by_db`` has a row per database with a schema file; its text is null or
    empty if the file declares no table. It is measured and then joined, and so written once before,
    unless it is ``stored`` already.
    """
    schema_by_db = schema_by_db if stored else written(schema_by_db.select("db_id", "schema_text"), "schema-texts")
    lookup = schema_by_db.select("db_id", "schema_text", F.lit(True).alias("has_schema_file"))
    joined = lookup_join(questions, lookup, "db_id", "index", broadcast_limit)
    return joined.withColumn("has_schema_file", F.coalesce("has_schema_file", F.lit(False)))


def validate_rows(questions: DataFrame) -> DataFrame:
    """Add ``status`` and ``error``; the first thing that is missing counts."""
    no_file_head, no_file_tail = NO_SCHEMA_FILE.split("{db_id}")
    error = (
        F.when(F.col("index").isNull() | (F.col("index") < 0), NO_INDEX)
        .when(F.col("db_id") == "", NO_DB_ID)
        .when(F.col("question") == "", NO_QUESTION)
        .when(~F.col("has_schema_file"), F.concat(F.lit(no_file_head), "db_id", F.lit(no_file_tail)))
        .when(F.coalesce("schema_text", F.lit("")) == "", NO_SCHEMA)
        .otherwise("")
    )
    return questions.withColumn("error", error).withColumn(
        "status", F.when(F.col("error") == "", "ok").otherwise("error")
    )
