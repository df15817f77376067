"""The prediction table: one row per question that was tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import read_or_empty

# The columns of the prediction table, in order.
PREDICTIONS = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("gold_sql", T.StringType()),
        T.StructField("predicted_sql", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("elapsed_sec", T.DoubleType()),
    ]
)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The table, also of runs that the streaming job wrote into sub-folders.

    Before the first run it is empty.
    """
    return read_or_empty(spark, path, PREDICTIONS, recursiveFileLookup="true")


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Add rows to the table; a rerun without resume adds them again."""
    predictions.select(PREDICTIONS.fieldNames()).write.mode("append").parquet(path)


def completed_indices(predictions: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Indices that need no further run. Rows with an error count as done unless retried."""
    done = predictions.where(F.col("index").isNotNull())
    if retry_errors:
        done = done.where(F.col("status") != "error")
    return done.select(F.col("index").cast("long").alias("index")).distinct()


# White space at the ends of a text is part of it; CSV drops it unless told not to.
CSV = {
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "encoding": "UTF-8",
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def export_csv(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """The table as CSV, for tools that cannot read Parquet."""
    predictions.select(PREDICTIONS.fieldNames()).write.mode(mode).options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from CSV. Empty texts come back from CSV as nulls, so they are refilled."""
    table = spark.read.schema(PREDICTIONS).options(**CSV).csv(path)
    texts = [f.name for f in PREDICTIONS.fields if isinstance(f.dataType, T.StringType)]
    return table.fillna("", subset=texts)
