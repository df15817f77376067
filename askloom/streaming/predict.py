"""Predictions for questions that keep arriving as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import BATCH_BYTES, GENERATION, Model, ModelSettings, predict
from ..operators.questions import attach_schema, coerce_fields, validate_rows
from ..sources.finished import note_finished, runs_folder, without_finished
from ..sources.predictions import PREDICTIONS
from ..sources.questions import QUESTION_LINES
from ..storage import written


def read_question_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(QUESTION_LINES).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def stream_predictions(
    samples: DataFrame,
    schema_by_db: DataFrame,
    output: str,
    checkpoint: str,
    model: Model,
    resume: bool = False,
    dialect: str = "SQL",
    settings: ModelSettings = GENERATION,
    batch_size: int = 32,
    concurrency: int | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> StreamingQuery:
    """Predict what has arrived and stop; a later run goes on where this one ended.

    A micro-batch may be repeated after a failure, so each has a folder of its own
    that a repetition overwrites: every question is in the table once. The folder is
    named after the id that the checkpoint gives the stream, so streams can share a
    table, and one that starts afresh at an old path overwrites nothing. With ``resume``
    a micro-batch reads bitmaps of finished indices for the segments of its own questions, and
    no predictions; see ``sources.finished``.
    """
    schema_by_db = written(schema_by_db, "schema-texts")

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        started = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()
        writer = f"stream_{started['id']}"
        folder = runs_folder(writer, batch_id)
        questions = coerce_fields(batch)
        if resume:
            # A repeated batch must not take its own earlier rows for finished work.
            questions = without_finished(questions, output, repeats=(writer, batch_id))
        questions = questions.repartition(concurrency) if concurrency else questions
        ready = validate_rows(attach_schema(questions, schema_by_db, stored=True))
        predictions = predict(ready, model, dialect, settings, batch_size, concurrency, batch_bytes)
        predictions.select(PREDICTIONS.fieldNames()).write.mode("overwrite").parquet(
            f"{output}/{folder}"
        )
        note_finished(spark, output, writer, batch_id, folder)

    return (
        samples.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
