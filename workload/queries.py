"""Every operator as a query over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.ddl import clean_ddl, normalize_ddl, statement_kind
from askloom.functions.prompts import REVIEW_SEPARATOR, build_prompt, build_review_prompt
from askloom.functions.replies import (
    clean_sql_reply,
    extract_payloads,
    parse_replies,
    parse_verdict,
    review_fold,
)
from askloom.operators import catalog, questions, report
from askloom.operators.execute import execute_batch, execute_query, result_rows
from askloom.operators.load import load_dump
from askloom.operators.model import generate_batch, predict
from askloom.operators.review import review
from askloom.plans.ask import answer_batch, ask, open_dump
from askloom.plans.generate import run_batch
from askloom.sources import predictions as table
from askloom.sources.dumps import scan_dump
from askloom.sources.questions import explode_samples, scan_question_lines
from askloom.sources.schema_files import resolve_schema_files
from askloom.storage import new_folder, written
from askloom.streaming.predict import read_question_stream, stream_predictions

from . import fixtures as fx
from .sql import SQL, spark_sql

Spark = SparkSession


# -- Sources --------------------------------------------------------------------------


def scan_questions(spark: Spark, sf_dir: str) -> DataFrame:
    return explode_samples(spark.read.text(fx.question_sets(spark, sf_dir)))


def _question_lines(spark: Spark, sf_dir: str, files: int | None = None) -> str:
    folder = new_folder(spark, "questions")
    rows = fx.samples(spark, sf_dir)
    (rows.repartition(files) if files else rows).write.json(folder)
    return folder


def question_lines(spark: Spark, sf_dir: str) -> DataFrame:
    return scan_question_lines(spark, _question_lines(spark, sf_dir))


def scan_dump_statements(spark: Spark, sf_dir: str) -> DataFrame:
    return scan_dump(spark, fx.client_dump(spark, sf_dir)).select(
        fx.shard_of().alias("shard"), "stmt_no", "stmt"
    )


def classify_statements(spark: Spark, sf_dir: str) -> DataFrame:
    return scan_dump(spark, fx.client_dump(spark, sf_dir)).select(
        fx.shard_of().alias("shard"), "stmt_no", statement_kind(F.col("stmt")).alias("kind")
    )


def load_dump_rows(spark: Spark, sf_dir: str) -> DataFrame:
    return load_dump(scan_dump(spark, fx.client_dump(spark, sf_dir))).tables["client"]


def load_dump_articles(spark: Spark, sf_dir: str) -> DataFrame:
    return load_dump(scan_dump(spark, fx.article_dump(spark, sf_dir))).tables["article"]


def load_dump_numbered(spark: Spark, sf_dir: str) -> DataFrame:
    return load_dump(scan_dump(spark, fx.visit_dump(spark, sf_dir))).tables["visit"]


def load_dump_keys(spark: Spark, sf_dir: str) -> DataFrame:
    return load_dump(scan_dump(spark, fx.member_dump(spark, sf_dir))).tables["member"]


def load_dump_refused(spark: Spark, sf_dir: str) -> DataFrame:
    rejects = load_dump(scan_dump(spark, fx.member_dump(spark, sf_dir))).rejects
    return rejects.groupBy("table_name", "error").agg(F.count(F.lit(1)).alias("n"))


def load_dump_tally(spark: Spark, sf_dir: str) -> DataFrame:
    return load_dump(scan_dump(spark, fx.tally_dump(spark, sf_dir))).tables["tally"]


def load_dump_derived(spark: Spark, sf_dir: str) -> DataFrame:
    return load_dump(scan_dump(spark, fx.tally_dump(spark, sf_dir))).tables["rich"]


def load_dump_lines(spark: Spark, sf_dir: str) -> DataFrame:
    lines = load_dump(scan_dump(spark, fx.line_dump(spark, sf_dir))).tables["line"]
    return lines.withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice")})


def resolve_schema_file(spark: Spark, sf_dir: str) -> DataFrame:
    """Three files, of five kinds, for each database."""
    db_id = "concat(source, '_', doc_id div 60)"
    files = fx.read(spark, sf_dir, "documents").selectExpr(
        f"{db_id} AS db_id",
        f"CASE doc_id div 20 % 5 WHEN 0 THEN 'schema.sql' WHEN 1 THEN concat({db_id}, '.sql')"
        " WHEN 2 THEN concat('a_', doc_id, '.sql') WHEN 3 THEN concat('z_', doc_id, '.sql')"
        " ELSE 'notes.txt' END AS file_name",
    )
    return resolve_schema_files(files)


# -- DDL and schema documents -----------------------------------------------------------


def normalize(spark: Spark, sf_dir: str) -> DataFrame:
    stmt = F.concat("stmt", F.lit(";"))
    return fx.ddl(spark, sf_dir).select("p_partkey", normalize_ddl(stmt).alias("ddl"))


def clean(spark: Spark, sf_dir: str) -> DataFrame:
    stmt = F.concat("stmt", F.lit(";"))
    return fx.ddl(spark, sf_dir).select("p_partkey", clean_ddl(normalize_ddl(stmt)).alias("ddl"))


def _docs(spark: Spark, sf_dir: str) -> DataFrame:
    return catalog.schema_docs(fx.ddl_statements(spark, sf_dir), F.col("path"))


def list_tables(spark: Spark, sf_dir: str) -> DataFrame:
    return catalog.list_tables(fx.ddl_statements(spark, sf_dir), F.col("path"))


def _store(spark: Spark, sf_dir: str) -> str:
    folder = new_folder(spark, "schema-docs")
    docs = _docs(spark, sf_dir)
    catalog.store_schema_docs(docs, folder)
    return folder


def store_schema_docs(spark: Spark, sf_dir: str) -> DataFrame:
    """Stored twice: the second time changes nothing, though the documents differ."""
    folder = _store(spark, sf_dir)
    changed = _docs(spark, sf_dir).withColumn("doc", F.concat("doc", F.lit(" changed")))
    catalog.store_schema_docs(changed, folder)
    return catalog.read_schema_docs(spark, folder)


def read_schema_docs(spark: Spark, sf_dir: str) -> DataFrame:
    return catalog.read_schema_docs(spark, _store(spark, sf_dir), "db1")


def store_count_check(spark: Spark, sf_dir: str) -> DataFrame:
    sent = fx.ddl_statements(spark, sf_dir).select(F.col("path").alias("db_id"))
    stored = catalog.read_schema_docs(spark, _store(spark, sf_dir))
    return catalog.store_count_check(sent, stored)


def schema_text_by_db(spark: Spark, sf_dir: str) -> DataFrame:
    return catalog.schema_text_by_db(_docs(spark, sf_dir))


# -- Questions --------------------------------------------------------------------------


def _questions(spark: Spark, sf_dir: str) -> DataFrame:
    return questions.coerce_fields(fx.samples(spark, sf_dir))


def _schemas(spark: Spark, sf_dir: str) -> DataFrame:
    """A row per database, also for those whose file declares no table."""
    files = fx.ddl(spark, sf_dir).select("db_id").distinct()
    return files.join(schema_text_by_db(spark, sf_dir), "db_id", "left")


def _ready(spark: Spark, sf_dir: str) -> DataFrame:
    return questions.validate_rows(attach_schema(spark, sf_dir))


def slice_questions(spark: Spark, sf_dir: str) -> DataFrame:
    return questions.slice_questions(_questions(spark, sf_dir), 500, 2000)


def resume_anti_join(spark: Spark, sf_dir: str) -> DataFrame:
    done = fx.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr(
        "o_orderkey AS index", "'error' AS status"
    )
    return questions.resume_anti_join(_questions(spark, sf_dir), table.completed_indices(done))


def distinct_databases(spark: Spark, sf_dir: str) -> DataFrame:
    return questions.distinct_databases(_questions(spark, sf_dir))


def attach_schema(spark: Spark, sf_dir: str) -> DataFrame:
    return questions.attach_schema(_questions(spark, sf_dir), _schemas(spark, sf_dir))


def attach_schema_salted(spark: Spark, sf_dir: str) -> DataFrame:
    """The way taken when the schema texts are too big to broadcast."""
    return questions.attach_schema(_questions(spark, sf_dir), _schemas(spark, sf_dir), broadcast_limit=0)


def validate_rows(spark: Spark, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("index", "status", "error")


# -- Prompts, model, review --------------------------------------------------------------


def prompts(spark: Spark, sf_dir: str) -> DataFrame:
    prompt = build_prompt(F.col("schema_text"), F.col("question"))
    return _ready(spark, sf_dir).select("index", F.when(F.col("status") == "ok", prompt).alias("prompt"))


def generate(spark: Spark, sf_dir: str) -> DataFrame:
    called = generate_batch(prompts(spark, sf_dir), fx.counting_model)
    return called.select("index", "call.reply", "call.error")


def predictions(spark: Spark, sf_dir: str) -> DataFrame:
    return predict(_ready(spark, sf_dir), fx.counting_model).drop("elapsed_sec")


def batch(spark: Spark, sf_dir: str) -> DataFrame:
    """The job in three runs: a slice, the rest by resuming, and one with nothing left."""
    folder = new_folder(spark, "predictions")
    rows, schemas = fx.samples(spark, sf_dir), _schemas(spark, sf_dir)
    run_batch(rows, schemas, folder, fx.counting_model, limit=1000, flush_every=400)
    run_batch(rows, schemas, folder, fx.counting_model, resume=True)
    run_batch(rows, schemas, folder, fx.counting_model, resume=True)
    return table.read_predictions(spark, folder).drop("elapsed_sec")


def stream(spark: Spark, sf_dir: str) -> DataFrame:
    """The job as a stream that is stopped and started again over a growing folder."""
    lines = _question_lines(spark, sf_dir, files=4)
    folder, checkpoint = new_folder(spark, "predictions"), new_folder(spark, "checkpoint")
    schemas = _schemas(spark, sf_dir)
    for _ in range(2):
        samples = read_question_stream(spark, lines, files_per_batch=2)
        stream_predictions(samples, schemas, folder, checkpoint, fx.counting_model).awaitTermination()
    return table.read_predictions(spark, folder).drop("elapsed_sec")


def _to_review(spark: Spark, sf_dir: str) -> DataFrame:
    texts = catalog.schema_text_by_db(_docs(spark, sf_dir), REVIEW_SEPARATOR)
    good = predictions(spark, sf_dir).where("status = 'ok'").drop("status", "error")
    # What asks the model is written before it is joined, which may read it more than once.
    return questions.attach_schema(written(good, "predictions-to-review"), texts)


def review_prompts(spark: Spark, sf_dir: str) -> DataFrame:
    prompt = build_review_prompt(F.col("schema_text"), F.col("question"), F.col("predicted_sql"))
    return _to_review(spark, sf_dir).select("index", prompt.alias("prompt"))


def reviewed(spark: Spark, sf_dir: str) -> DataFrame:
    return review(_to_review(spark, sf_dir), fx.limiting_reviewer).select("index", "sql", "reviewed")


# -- Replies and verdicts ------------------------------------------------------------------


def payloads(spark: Spark, sf_dir: str) -> DataFrame:
    found = extract_payloads(fx.replies(spark, sf_dir), out="p")
    return found.select("index", "p.*", F.col("p").isNotNull().alias("is_object"))


def clean_sql(spark: Spark, sf_dir: str) -> DataFrame:
    return fx.replies(spark, sf_dir).select("index", clean_sql_reply(F.col("reply")).alias("sql"))


def parsed(spark: Spark, sf_dir: str) -> DataFrame:
    found = parse_replies(fx.replies(spark, sf_dir), out="p")
    return found.select("index", "p.*")


def parsed_documents(spark: Spark, sf_dir: str) -> DataFrame:
    found = parse_replies(fx.document_replies(spark, sf_dir), out="p")
    return found.select("index", "p.*")


def verdicts(spark: Spark, sf_dir: str) -> DataFrame:
    return fx.verdicts(spark, sf_dir).select(
        "index",
        parse_verdict(F.col("replies")[0]).alias("first"),
        parse_verdict(F.col("replies")[1]).alias("second"),
    )


def folded(spark: Spark, sf_dir: str) -> DataFrame:
    said = F.transform("replies", parse_verdict)
    return (
        fx.verdicts(spark, sf_dir)
        .select("index", review_fold(F.col("sql"), said).alias("r"))
        .select("index", "r.*")
    )


# -- Prediction table ------------------------------------------------------------------------


def _table(spark: Spark, sf_dir: str, times: int = 1) -> DataFrame:
    folder = new_folder(spark, "predictions")
    for _ in range(times):
        table.append_predictions(fx.predictions(spark, sf_dir), folder)
    return table.read_predictions(spark, folder)


def completed_indices(spark: Spark, sf_dir: str) -> DataFrame:
    return table.completed_indices(_table(spark, sf_dir))


def completed_indices_retry(spark: Spark, sf_dir: str) -> DataFrame:
    return table.completed_indices(_table(spark, sf_dir), retry_errors=True)


def append_predictions(spark: Spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, times=2)


def export_csv(spark: Spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "predictions-csv")
    table.export_csv(fx.predictions(spark, sf_dir), folder)
    return table.read_csv(spark, folder)


def run_report(spark: Spark, sf_dir: str) -> DataFrame:
    return report.run_report(_table(spark, sf_dir)).withColumn("avg_sec", F.round("avg_sec", 6))


def preview(spark: Spark, sf_dir: str) -> DataFrame:
    return report.preview(_table(spark, sf_dir), 50)


# -- Execution ---------------------------------------------------------------------------------


def _conformance(key: str):
    def run(spark: Spark, sf_dir: str) -> DataFrame:
        fx.register(spark, sf_dir, spark_sql(key))
        result = execute_query(spark, spark_sql(key), lazy=True)
        if result.rows is None:
            raise ValueError(result.error)
        return result.rows

    return run


def _executed(spark: Spark, sf_dir: str) -> tuple[DataFrame, str]:
    """A predicted SQL for each customer, of 13 kinds, six of which reach beyond the
    tables and are refused; equal texts are run once."""
    fx.register(spark, sf_dir, "customer nation")
    sql = F.expr(
        "CASE c_custkey % 13 WHEN 0 THEN concat('SELECT c_nationkey, count(*) AS n FROM customer"
        " WHERE c_mktsegment = \\'', c_mktsegment, '\\' GROUP BY c_nationkey')"
        " WHEN 1 THEN 'WITH n AS (SELECT n_name FROM nation) SELECT * FROM n'"
        " WHEN 2 THEN 'SELECT * FROM no_such_table' WHEN 3 THEN 'SELECT * FROM nation WHERE n_nationkey < 0'"
        " WHEN 4 THEN 'DROP VIEW customer' WHEN 5 THEN 'SELECT 1 / (n_nationkey - n_nationkey) FROM nation'"
        " WHEN 6 THEN 'SELECT TRANSFORM(n_name) USING \\'cat\\' AS (x) FROM nation'"
        " WHEN 7 THEN 'SELECT java_method(\\'java.lang.System\\', \\'lineSeparator\\')'"
        " WHEN 8 THEN 'SELECT IDENTIFIER(\\'java_method\\')(\\'java.lang.System\\', \\'lineSeparator\\')'"
        " WHEN 9 THEN 'SELECT count(*) FROM IDENTIFIER(\\'text.`/etc/hostname`\\')'"
        " WHEN 10 THEN 'SELECT 1 WHERE 0 < (SELECT count(*) FROM IDENTIFIER(\\'text\\' || \\'.`/etc/hostname`\\'))'"
        " WHEN 11 THEN 'SELECT n_name FROM IDENTIFIER(\\'nation\\')'"
        " ELSE 'SELECT count(*) FROM text.`/etc/hostname`' END"
    )
    rows = fx.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("index"), sql.alias("predicted_sql")
    )
    folder = new_folder(spark, "executed")
    return execute_batch(rows, folder), folder


def executed(spark: Spark, sf_dir: str) -> DataFrame:
    outcomes, _ = _executed(spark, sf_dir)
    return outcomes.select("index", "outcome", "n_rows", F.col("error").isNotNull().alias("has_error"))


def execute_outcomes(spark: Spark, sf_dir: str) -> DataFrame:
    outcomes, _ = _executed(spark, sf_dir)
    return outcomes.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows")
    )


def executed_rows(spark: Spark, sf_dir: str) -> DataFrame:
    _, folder = _executed(spark, sf_dir)
    return result_rows(spark, folder)


def answered(spark: Spark, sf_dir: str) -> DataFrame:
    """All questions: generated, reviewed and run over the tables."""
    fx.register(spark, sf_dir, "region")
    answers = answer_batch(
        fx.samples(spark, sf_dir), _docs(spark, sf_dir), new_folder(spark, "answered"),
        fx.region_model, fx.region_reviewer,
    )
    return answers.select("index", "status", "sql", "reviewed", "outcome", "n_rows")


def ask_dump(spark: Spark, sf_dir: str) -> DataFrame:
    """From a dump of the customers to the rows that answer a question about it."""
    _, docs = open_dump(spark, fx.client_dump(spark, sf_dir))
    answer = ask(spark, "How many clients has each segment?", docs, fx.segment_model, fx.agreeing_reviewer)
    if answer.rows is None:
        raise ValueError(answer.error)
    return answer.rows


QUERIES = {
    "scan_questions": scan_questions,
    "scan_question_lines": question_lines,
    "scan_dump_statements": scan_dump_statements,
    "classify_statements": classify_statements,
    "load_dump_rows": load_dump_rows,
    "load_dump_articles": load_dump_articles,
    "load_dump_lines": load_dump_lines,
    "load_dump_numbered": load_dump_numbered,
    "load_dump_keys": load_dump_keys,
    "load_dump_refused": load_dump_refused,
    "load_dump_tally": load_dump_tally,
    "load_dump_derived": load_dump_derived,
    "list_tables": list_tables,
    "normalize_ddl": normalize,
    "clean_ddl": clean,
    "schema_docs": _docs,
    "store_schema_docs": store_schema_docs,
    "read_schema_docs": read_schema_docs,
    "store_count_check": store_count_check,
    "schema_text_by_db": schema_text_by_db,
    "resolve_schema_file": resolve_schema_file,
    "coerce_fields": _questions,
    "slice_questions": slice_questions,
    "resume_anti_join": resume_anti_join,
    "distinct_databases": distinct_databases,
    "attach_schema": attach_schema,
    "attach_schema_salted": attach_schema_salted,
    "validate_rows": validate_rows,
    "build_prompt": prompts,
    "build_review_prompt": review_prompts,
    "generate_batch": generate,
    "predict": predictions,
    "run_batch": batch,
    "stream_predictions": stream,
    "review": reviewed,
    "extract_json_payload": payloads,
    "clean_sql_reply": clean_sql,
    "parse_reply": parsed,
    "parse_reply_documents": parsed_documents,
    "parse_verdict": verdicts,
    "review_fold": folded,
    "completed_indices": completed_indices,
    "completed_indices_retry": completed_indices_retry,
    "append_predictions": append_predictions,
    "export_csv": export_csv,
    "run_report": run_report,
    "preview": preview,
    "execute_outcomes": execute_outcomes,
    "execute_batch": executed,
    "execute_batch_rows": executed_rows,
    "answer_batch": answered,
    "ask": ask_dump,
    **{key: _conformance(key) for key in SQL},
}
