"""One question to one database, from its dump to the rows of the answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import REVIEW_SEPARATOR
from ..operators.catalog import schema_docs, schema_text_by_db
from ..operators.execute import execute_batch, execute_query, sql_key
from ..operators.joins import lookup_join
from ..operators.load import LoadedDump, load_dump
from ..operators.model import Model, predict
from ..operators.questions import attach_schema, coerce_fields, validate_rows
from ..operators.review import review
from ..sources.dumps import scan_dump
from ..storage import written

DIALECT = "Spark SQL"


@dataclass
class Answer:
    sql: str
    summary: str
    reviewed: bool
    rows: DataFrame | None
    error: str | None


def answer_questions(
    samples: DataFrame, docs: DataFrame, model: Model, reviewer: Model | None = None
) -> DataFrame:
    """Predictions with their reviewed ``sql``, for any number of questions and databases.

    The result is a written table, so using it twice asks the model no second time.
    """
    docs = docs if reviewer is None else written(docs, "schema-docs")
    texts = written(schema_text_by_db(docs), "schema-texts")
    ready = validate_rows(attach_schema(coerce_fields(samples), texts, stored=True))
    predictions = written(predict(ready, model, DIALECT), "predictions")
    if reviewer is None:
        return predictions.withColumn("sql", F.col("predicted_sql")).withColumn(
            "reviewed", F.lit(False)
        )
    texts = written(schema_text_by_db(docs, REVIEW_SEPARATOR), "schema-texts")
    to_review = attach_schema(predictions, texts, stored=True)
    reviewed = review(to_review, reviewer).drop("schema_text", "has_schema_file")
    return written(reviewed, "reviewed-predictions")


def answer_batch(
    samples: DataFrame,
    docs: DataFrame,
    folder: str,
    model: Model,
    reviewer: Model | None = None,
    by_database: bool = False,
) -> DataFrame:
    """Generate, review and run for many questions; none that fails stops the others.

    Returns the predictions with ``sql_key``, ``outcome``, ``n_rows`` and ``run_error``;
    the rows are below ``folder`` (see ``result_rows``). Questions without SQL have
    none of these.
    """
    answers = answer_questions(samples, docs, model, reviewer)
    db = F.col("db_id") if by_database else F.lit("")
    keyed = written(answers.withColumn("sql_key", F.when(F.col("sql") != "", sql_key(db, F.col("sql")))), "answers")
    ran = execute_batch(keyed, folder, "sql", by_database=by_database)
    outcomes = ran.select("sql_key", "outcome", "n_rows", F.col("error").alias("run_error")).dropDuplicates(["sql_key"])
    # Questions without SQL stay apart, so that their null key is not a hot one.
    asked = lookup_join(keyed.where("sql_key IS NOT NULL"), written(outcomes, "outcomes"), "sql_key", "index")
    silent = keyed.where("sql_key IS NULL").withColumns(
        {"outcome": F.lit(None).cast("string"), "n_rows": F.lit(None).cast("long"), "run_error": F.lit(None).cast("string")}
    )
    return asked.unionByName(silent)


def open_dump(
    spark: SparkSession, path: str, line_sep: str = ";\n", backslash_escapes: bool = False
) -> tuple[LoadedDump, DataFrame]:
    """Load a dump, register its tables and return it with its schema documents.

    ``line_sep`` and ``backslash_escapes`` are those of ``scan_dump``.
    """
    loaded = load_dump(scan_dump(spark, path, line_sep, backslash_escapes))
    loaded.register()
    return loaded, schema_docs(loaded.declarations, F.lit("dump"))


def ask(
    spark: SparkSession,
    question: str,
    docs: DataFrame,
    model: Model,
    reviewer: Model | None = None,
) -> Answer:
    """Generate, review and run the SQL for one question over the registered tables.

    The SQL runs once; whatever goes wrong with it is the answer's ``error``.
    """
    sample = spark.createDataFrame(
        [(0, "dump", question, "")], "index long, db_id string, question string, query string"
    )
    row = answer_questions(sample, docs, model, reviewer).first()
    if row["status"] == "error":
        return Answer("", "", False, None, row["error"])
    result = execute_query(spark, row["sql"])
    return Answer(row["sql"], row["summary"], row["reviewed"], result.rows, result.error)
