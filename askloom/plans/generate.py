"""The batch job: a question set in, a prediction table out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_path
from ..operators.catalog import (
    read_schema_docs,
    schema_docs,
    schema_text_by_db,
    store_schema_docs,
    verify_store,
)
from ..operators.model import BATCH_BYTES, GENERATION, Model, ModelSettings, predict
from ..operators.questions import (
    attach_schema,
    coerce_fields,
    distinct_databases,
    require_rows,
    slice_questions,
    validate_rows,
)
from ..operators.report import run_report
from ..sources.dumps import scan_dump
from ..sources.finished import note_finished, runs_folder, without_finished
from ..sources.predictions import append_predictions, read_predictions
from ..sources.schema_files import list_schema_files, resolve_schema_files
from ..storage import broadcast_if_small, written


def schema_of_databases(
    questions: DataFrame,
    root: str,
    store: str,
    refresh: bool = False,
    line_sep: str = ";\n",
    backslash_escapes: bool = False,
) -> DataFrame:
    """(db_id, schema_text) of the databases asked about that have a schema file.

    Their dumps lie below ``<root>/database/<db_id>/``; only those files are read
    whose databases are not yet in ``store``. The driver holds their list, as it does
    for any table of files. What has been stored is counted and must be what was sent.
    ``line_sep`` and ``backslash_escapes`` are those of ``scan_dump``.
    """
    spark = questions.sparkSession
    files = resolve_schema_files(list_schema_files(spark, root)).join(
        distinct_databases(questions), "db_id", "left_semi"
    )
    files = written(files.select("db_id", "path"), "schema-files")
    fresh = files
    if not refresh:
        stored = read_schema_docs(spark, store).select("db_id").distinct()
        fresh = files.join(stored, "db_id", "left_anti")
    paths = [row["path"] for row in fresh.select(file_path(F.col("path")).alias("path")).toLocalIterator()]
    if paths:
        statements = scan_dump(spark, paths, line_sep, backslash_escapes).join(broadcast_if_small(fresh), "path")
        docs = written(schema_docs(statements, F.col("db_id")), "schema-docs")
        store_schema_docs(docs, store, refresh)
        sent = docs.select("db_id")
        verify_store(sent, read_schema_docs(spark, store).join(sent.distinct(), "db_id", "left_semi"))
    texts = schema_text_by_db(read_schema_docs(spark, store))
    return files.select("db_id").join(texts, "db_id", "left")


def run_batch(
    samples: DataFrame,
    schema_by_db: DataFrame,
    output: str,
    model: Model,
    start: int = 0,
    limit: int = 0,
    resume: bool = False,
    retry_errors: bool = False,
    flush_every: int = 0,
    dialect: str = "SQL",
    settings: ModelSettings = GENERATION,
    batch_size: int = 32,
    concurrency: int | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Predict, append to the table at ``output``, and report on the whole table.

    Rows are appended by jobs of ``flush_every`` rows each, by one job if it is 0
    or less. What has been appended stays when a later job fails, and a run with
    ``resume`` goes on from there: what is finished it takes from bitmaps beside the table.
    Nothing reads predictions before they are
    written, so no question is asked twice.
    """
    spark = samples.sparkSession
    questions = require_rows(slice_questions(coerce_fields(samples), start, limit))
    if resume:
        questions = without_finished(questions, output, retry_errors)
    if resume or flush_every > 0:
        questions = written(questions, "questions")
    schema_by_db = written(schema_by_db, "schema-texts")
    writer = f"run_{uuid.uuid4().hex}"
    for number, part in enumerate(_parts(questions, flush_every)):
        part = part.repartition(concurrency) if concurrency else part
        ready = validate_rows(attach_schema(part, schema_by_db, stored=True))
        predictions = predict(ready, model, dialect, settings, batch_size, concurrency, batch_bytes)
        folder = runs_folder(writer, number)
        append_predictions(predictions, f"{output}/{folder}")
        note_finished(spark, output, writer, number, folder)
    return run_report(read_predictions(spark, output))


def _parts(questions: DataFrame, size: int) -> Iterator[DataFrame]:
    """Ranges of the index that hold ``size`` rows each, as filters that the scan can use.

    Indices are sorted into ranges of tasks and numbered through by the ranges' counts; the
    driver gets every ``size``-th. Rows without an index are a part of their own.
    """
    if size <= 0:
        yield questions
        return
    known = questions.where("index IS NOT NULL").select("index")
    ranged = written(known.repartitionByRange("index").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    before = list(accumulate((row["n"] for row in counts), initial=0))
    offsets = F.create_map(*[F.lit(x) for row, n in zip(counts, before) for x in (row["range"], n)]) if counts else None
    if counts:
        inside = F.row_number().over(W.partitionBy("range").orderBy("index"))
        number = inside + offsets[F.col("range")] - 1
        starts = ranged.withColumn("number", number).where(F.col("number") % size == 0).select("index")
        cuts = sorted({row["index"] for row in starts.collect()})
        for lo, hi in zip(cuts, [*cuts[1:], None]):
            part = questions.where(F.col("index") >= lo)
            yield part if hi is None else part.where(F.col("index") < hi)
    lost = questions.where("index IS NULL")
    if not lost.isEmpty():
        yield lost
