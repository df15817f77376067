"""Question sets, their checks, and the joins around them."""

import json

import pytest
from pyspark.sql import functions as F

from askloom.functions.prompts import build_prompt, build_review_prompt
from askloom.functions.text import WHITESPACE, shorten, strip
from askloom.operators import catalog
from askloom.operators.joins import lookup_join, salted_join
from askloom.operators.questions import (
    attach_schema,
    coerce_fields,
    require_rows,
    resume_anti_join,
    slice_questions,
    validate_rows,
)
from askloom.sources.questions import resolve_question_path, scan_question_lines, scan_questions
from askloom.sources.schema_files import list_schema_files, resolve_schema_files

SAMPLES = [
    {"db_id": " shop ", "question": "\n\tHow many? ", "query": "SELECT 1 ", "other": [1]},
    {"question": "no db", "query": None},
    {"db_id": "shop", "db_idx": "x"},
    {"db_id": "shop", "question": 5, "query": "SELECT 'é\n' "},
]


def test_json_array(spark, tmp_path):
    path = tmp_path / "dev.json"
    path.write_text("\n " + json.dumps(SAMPLES, indent=1), encoding="utf-8")
    rows = coerce_fields(scan_questions(spark, str(path))).orderBy("index").collect()
    assert [tuple(r) for r in rows] == [
        (0, "shop", "How many?", "SELECT 1"),
        (1, "", "no db", ""),
        (2, "shop", "", ""),
        (3, "shop", "5", "SELECT 'é\n'"),
    ]


@pytest.mark.parametrize("text", ['{"db_id": "a"}', "12", '[{"db_id": "a"', " "])
def test_not_an_array(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="Expected a list"):
        scan_questions(spark, str(path)).collect()


def test_empty_array_selects_nothing(spark, tmp_path):
    path = tmp_path / "empty.json"
    path.write_text("[]")
    with pytest.raises(ValueError, match="No rows selected"):
        require_rows(coerce_fields(scan_questions(spark, str(path))))


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"index": i + 7, **s}) for i, s in enumerate(SAMPLES[:2])]
    (tmp_path / "part.jsonl").write_text("\n".join(lines))
    rows = scan_question_lines(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["index"], r["question"]) for r in rows] == [(7, SAMPLES[0]["question"]), (8, "no db")]


def test_resolve_question_path(spark, tmp_path):
    given = tmp_path / "here.json"
    given.write_text("[]")
    assert resolve_question_path(spark, "/root/else", str(given)) == str(given)
    assert resolve_question_path(spark, "/root/else/", "dev.json") == "/root/else/dev.json"


def test_strip_like_python(spark):
    texts = ["", " ", "a", *[c + "a" + c + "b" + c + c for c in WHITESPACE], "​ a ​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", strip(F.col("t")).alias("s")).collect():
        assert row["s"] == row["t"].strip(), repr(row["t"])


def test_shorten(spark):
    df = spark.createDataFrame([("é" * n,) for n in (0, 4, 5, 6)], "t string")
    got = [r[0] for r in df.select(shorten(F.col("t"), 5)).collect()]
    assert got == ["", "éééé", "ééééé", "ééééé..."]


@pytest.mark.parametrize(
    "start,limit,want",
    [(0, 0, range(10)), (-3, 4, range(4)), (7, 9, range(7, 10)), (4, -1, range(4, 10)), (10, 1, [])],
)
def test_slice(spark, start, limit, want):
    rows = slice_questions(spark.range(10).withColumnRenamed("id", "index"), start, limit).collect()
    assert sorted(r["index"] for r in rows) == list(want)


def test_resume_leaves_nothing_after_a_full_run(spark):
    rows = spark.range(100).withColumnRenamed("id", "index")
    assert resume_anti_join(rows, rows).count() == 0
    assert resume_anti_join(rows, rows.where("index % 3 = 0")).count() == 66


def test_first_missing_thing_counts(spark):
    questions = spark.createDataFrame(
        [(0, "", ""), (1, "a", ""), (2, "gone", "q"), (3, "empty", "q"), (4, "a", "q")],
        "index long, db_id string, question string",
    )
    schemas = spark.createDataFrame([("a", "T"), ("empty", None)], "db_id string, schema_text string")
    rows = validate_rows(attach_schema(questions, schemas)).orderBy("index").collect()
    assert [(r["status"], r["error"]) for r in rows] == [
        ("error", "Missing db_id in sample."),
        ("error", "Missing question in sample."),
        ("error", "Schema SQL not found for db_id='gone'"),
        ("error", "No schema available to generate SQL"),
        ("ok", ""),
    ]


def test_joins_agree_on_a_hot_key(spark):
    """Half of the rows share one key, and some keys have no partner."""
    rows = spark.range(20000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    lookup = spark.range(40).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    lookup = lookup.union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    want = sorted(map(tuple, rows.join(lookup, "k", "left").select("id", "k", "v").collect()), key=lambda r: r[0])
    for joined in (
        salted_join(rows, lookup, "k", "id", hot_keys=20),
        lookup_join(rows, lookup, "k", "id", broadcast_limit=0),
        lookup_join(rows, lookup, "k", "id"),
    ):
        got = sorted(map(tuple, joined.select("id", "k", "v").collect()), key=lambda r: r[0])
        assert got == want


def test_hot_key_is_spread(spark):
    rows = spark.range(20000).select("id", F.lit("hot").alias("k"))
    lookup = spark.createDataFrame([("hot", 1)], "k string, v long")
    before = {
        name: spark.conf.get(name)
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(rows, lookup, "k", "id", hot_keys=100)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in sizes) == 20000
    assert max(r["count"] for r in sizes) < 20000 / 3


def test_the_salted_join_is_shuffled_and_bears_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "hot") for i in range(300)] + [(300, "rare"), (301, "none")], "id long, k string")
    lookup = spark.createDataFrame([("hot", 1), ("rare", 2)], "k string, v long")
    joined = salted_join(rows, lookup, "k", "id", hot_keys=50)
    assert "SortMergeJoin" in joined._jdf.queryExecution().simpleString()
    got = {r["id"]: r["v"] for r in joined.collect()}
    assert got == {**{i: None if i % 3 else 1 for i in range(300)}, 300: 2, 301: None}
    assert salted_join(rows.limit(0), lookup, "k", "id").count() == 0


PROMPT = """You are a SQL expert. Generate a SQL query for this question using ONLY the schema below.

SCHEMA:
S {question}

QUESTION: Q {schema}

Generate result in JSON format
result={
    "sql_query": "sql query",
    "summary": "summary of the query"
}
RULES:
1. Return ONLY the JSON result
2. Do NOT include explanations
3. Use correct table/column names from schema
4. Query must be syntactically valid
5. If question is ambiguous, make reasonable assumptions

JSON RESULT:"""


def test_prompts(spark):
    df = spark.createDataFrame([("S {question}", "Q {schema}", "X")], "s string, q string, x string")
    row = df.select(
        build_prompt(F.col("s"), F.col("q")).alias("plain"),
        build_prompt(F.col("s"), F.col("q"), "Spark SQL").alias("spark"),
        build_review_prompt(F.col("s"), F.col("q"), F.col("x")).alias("review"),
    ).first()
    assert row["plain"] == PROMPT
    assert row["spark"].startswith("You are a Spark SQL expert. Generate a Spark SQL query")
    assert row["review"].startswith("\nPlease review this SQL query for correctness.\n\nDatabase Schema:\nS {question}\n")
    assert "\nUser Question:\nQ {schema}\n\nGenerated SQL Query:\nX\n\nPlease respond" in row["review"]
    assert row["review"].endswith("\nDo not include any other text or explanations.\n")


def test_schema_files(spark, tmp_path):
    layout = {
        "one": ["schema.sql", "one.sql", "a.sql"],
        "two": ["two.sql", "a.sql"],
        "three": ["b.sql", "a.sql", "notes.txt"],
        "with space": ["x y.sql"],
        "a+b%": ["c+d é.sql"],
        "none": ["notes.txt"],
    }
    for db, names in layout.items():
        (tmp_path / "database" / db).mkdir(parents=True)
        for name in names:
            (tmp_path / "database" / db / name).write_text("SELECT 1;\n")
    files = resolve_schema_files(list_schema_files(spark, str(tmp_path))).collect()
    assert {r["db_id"]: r["file_name"] for r in files} == {
        "one": "schema.sql", "two": "two.sql", "three": "a.sql", "with space": "x y.sql",
        "a+b%": "c+d é.sql",
    }


def test_declarations_are_dealt_out_and_schemas_made_once(spark):
    """However few files declare the tables; a lookup that is measured and joined is not made twice."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [(f"db{i // 2}", i % 2, 0, f"CREATE TABLE t{i} (id INT)") for i in range(40)]
    statements = spark.createDataFrame(rows, "path string, stmt_no int, part_no int, stmt string").coalesce(1)
    docs = catalog.schema_docs(statements, F.col("path"))
    assert "REPARTITION_BY_COL" in docs._jdf.queryExecution().executedPlan().toString()
    texts = catalog.schema_text_by_db(docs).withColumn("schema_text", counted("schema_text"))
    asked = spark.createDataFrame([(i, f"db{i}", "q", "") for i in range(22)], "index long, db_id string, question string, gold_sql string")
    found = {r["index"]: r["schema_text"] for r in attach_schema(asked, texts).collect()}
    assert "t6" in found[3] and "t7" in found[3]
    assert found[20] is None and made.value == 20
