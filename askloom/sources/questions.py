"""Question sets: JSON arrays of samples, or JSON lines with an index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys read from a sample; all others are ignored.
SAMPLE = "struct<db_id:string,question:string,query:string>"
QUESTION_LINES = "index long, db_id string, question string, query string"
NOT_A_LIST = "Unsupported dataset format. Expected a list of examples."


def samples(text: Column) -> Column:
    """The samples of one JSON array; the query fails if the text is no array."""
    parsed = F.from_json(text, f"array<{SAMPLE}>", {"allowSingleQuotes": "false"})
    return F.coalesce(
        F.when(text.rlike(r"^\s*\["), parsed), F.raise_error(F.lit(NOT_A_LIST)).cast(f"array<{SAMPLE}>")
    )


def explode_samples(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per sample; ``index`` is the sample's position in its array.

    The outer form of explode with a filter after it parses each array once; the
    plain form has the optimizer put a filter on the parsed array before it.
    """
    others = [c for c in df.columns if c != text]
    exploded = df.select(*others, F.posexplode_outer(samples(F.col(text))).alias("pos", "sample"))
    return exploded.where(F.col("pos").isNotNull()).select(
        *others, F.col("pos").cast("long").alias("index"), "sample.*"
    )


def scan_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set in one JSON file: (index, db_id, question, query).

    The file is one value, so it must stay below Spark's 2 GB per string; larger
    sets belong in JSON lines (``scan_question_lines``), which Spark splits.
    """
    return explode_samples(spark.read.text(path, wholetext=True))


def scan_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """A question set in JSON lines, each with its ``index``; splits at any size."""
    return spark.read.schema(QUESTION_LINES).json(path)


def resolve_question_path(spark: SparkSession, root: str, name: str) -> str:
    """``name`` itself if it exists as given, else the file of that name under ``root``."""
    try:
        spark.read.format("binaryFile").load(name).select("path").isEmpty()
        return name
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return f"{root.rstrip('/')}/{name}"
