"""Execution of SQL text and the path from a dump to an answer."""

import json

import pytest
from pyspark.sql import functions as F

from askloom import answer_batch, ask, execute_batch, execute_query, open_dump, result_rows
from askloom.operators.catalog import list_views
from askloom.operators.execute import as_json_rows


@pytest.fixture()
def numbers(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    return spark


@pytest.mark.parametrize(
    "sql,n",
    [
        ("SELECT * FROM numbers", 5),
        ("  select id from numbers where id > 2 ; ", 2),
        ("WITH a AS (SELECT 1 AS x) SELECT * FROM a", 1),
        ("VALUES (1), (2)", 2),
        ("(SELECT 1) UNION ALL (SELECT 2)", 2),
        ("SELECT id FROM numbers ORDER BY id DESC LIMIT 2 -- two", 2),
        ("/* why */ SELECT 1", 1),
        ("SELECT 1; -- done; really\n/* yes; */ ;", 1),
        ("SELECT ';' AS a, '; --' AS b", 1),
        ("SELECT 1 WHERE false", 0),
    ],
)
def test_query_forms(numbers, sql, n):
    result = execute_query(numbers, sql)
    assert result.error is None and result.rows.count() == n


def test_order_is_kept(numbers):
    rows = execute_query(numbers, "SELECT id FROM numbers ORDER BY id DESC").rows.collect()
    assert [r["id"] for r in rows] == [4, 3, 2, 1, 0]


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW numbers",
        "CREATE TABLE t (a INT)",
        "INSERT INTO numbers VALUES (1)",
        "SELECT 1) UNION (SELECT 2",
        "SELECT * FROM missing",
        "SELECT nope FROM numbers",
        "not sql",
        "",
    ],
)
def test_errors_are_values_and_change_nothing(numbers, sql):
    result = execute_query(numbers, sql)
    assert result.rows is None and result.error.startswith("Execution error: ")
    assert "numbers" in list_views(numbers)


def test_errors_of_values(numbers):
    sql = "SELECT 1 / (id - 3) AS x FROM numbers"
    checked = execute_query(numbers, sql)
    assert checked.rows is None and "DIVIDE_BY_ZERO" in checked.error
    assert execute_query(numbers, sql, lazy=True).error is None
    odd = execute_query(numbers, "SELECT id, id, NULL AS n FROM numbers ORDER BY 1 DESC").rows
    assert [tuple(r) for r in odd.collect()] == [(k, k, None) for k in (4, 3, 2, 1, 0)]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM numbers",
        "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM numbers) t",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT (SELECT max(`reflect` ('java.lang.System', 'lineSeparator')) FROM numbers)",
        "SELECT try_reflect /* why */ ('java.lang.System', 'lineSeparator')",
        "SELECT count(*) FROM text.`/etc/hostname`",
        "SELECT id FROM numbers WHERE id IN (SELECT length(value) FROM text.`/etc/hostname`)",
        "WITH t AS (SELECT * FROM csv.`/etc/hostname`) SELECT * FROM t",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
        "SELECT IDENTIFIER('builtin.reflect')('java.lang.System', 'lineSeparator')",
        "SELECT id, IDENTIFIER('java' || '_method')('java.lang.System', 'lineSeparator') FROM numbers",
        "SELECT count(*) FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT id FROM numbers WHERE EXISTS (SELECT 1 FROM IDENTIFIER('text' || '.`/etc/hostname`'))",
        "SELECT transform(array(1), x -> java_method('java.lang.System', 'lineSeparator'))",
        "SELECT sum(id) OVER (ORDER BY reflect('java.lang.System', 'lineSeparator')) FROM numbers",
        "SELECT system.builtin.java_method('java.lang.System', 'lineSeparator')",
        "SELECT * FROM numbers PIVOT (max(id) FOR id IN (1, 2)) JOIN text.`/etc/hostname`",
        "SELECT * FROM numbers, LATERAL (SELECT * FROM json.`/etc/hostname`)",
        "SELECT * FROM sql_keywords()",
        "SELECT '${system:user.home}'",
        "SELECT * FROM numbers LIMIT (SELECT count(*) FROM orc.`/etc`)",
    ],
)
def test_queries_that_reach_beyond_the_tables_are_refused(numbers, sql):
    result = execute_query(numbers, sql)
    assert result.rows is None and "Refused" in result.error


@pytest.mark.parametrize(
    "sql,n",
    [
        ("SELECT IDENTIFIER('id') FROM IDENTIFIER('numbers')", 5),
        ("SELECT IDENTIFIER('upper')('x'), IDENTIFIER('numbers.id') FROM numbers", 5),
        ("SELECT n.id, count(*) FILTER (WHERE n.id > 1), max(n.id) OVER (PARTITION BY n.id ROWS 2 PRECEDING) FROM numbers n GROUP BY ALL", 5),
        ("SELECT * FROM range(3) t(a) CROSS JOIN numbers TABLESAMPLE (100 PERCENT)", 15),
        ("SELECT k, v FROM numbers LATERAL VIEW explode(map('a', id)) AS k, v WHERE id BETWEEN 1 AND 3", 3),
        ("SELECT * FROM (SELECT id % 2 AS g, id FROM numbers) PIVOT (sum(id) AS s FOR g IN (0 AS even, 1 AS odd))", 1),
        ("SELECT * FROM (SELECT 1 AS a, 2 AS b) UNPIVOT (v FOR n IN (a, b))", 2),
        ("SELECT id FROM numbers INTERSECT SELECT 1 EXCEPT SELECT 2", 1),
        ("SELECT id FROM numbers MINUS SELECT 1 ORDER BY id DESC NULLS LAST LIMIT 3 OFFSET 1", 3),
        ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT * FROM t", 4),
        ("SELECT CASE WHEN id IN (SELECT 1) THEN 'a' ELSE id::string || '!' END, transform(array(id), x -> x + 1)[0] FROM numbers", 5),
        ("SELECT g, grouping(g) FROM (SELECT id % 2 AS g FROM numbers) GROUP BY ROLLUP (g) HAVING count(*) > 0 WINDOW w AS (ORDER BY g)", 3),
        ("SELECT DATE '2020-01-01' + INTERVAL 1 DAY, EXTRACT(YEAR FROM current_date()), substring('abc' FROM 2 FOR 1), trim(BOTH 'x' FROM 'xax'), "
         "current_date, 'a' LIKE 'b%' ESCAPE '!', 'a' RLIKE 'b', 1 <=> NULL, NOT true, -id, id div 2, named_struct('a', 1).a, "
         "position('b' IN 'abc'), CAST(id AS DECIMAL(5, 2)), TRY_CAST('x' AS INT), id IS NOT DISTINCT FROM 1, "
         "percentile_cont(0.5) WITHIN GROUP (ORDER BY id), any_value(id), TIMESTAMPADD(DAY, 1, TIMESTAMP '2020-01-01') "
         "FROM numbers GROUP BY id", 5),
        ("SELECT /*+ BROADCAST(a) */ a.id FROM numbers a JOIN numbers b USING (id) LEFT SEMI JOIN numbers c ON a.id = c.id", 5),
        ("SELECT DISTINCT * EXCEPT (k) FROM (SELECT id, 1 AS k FROM numbers NATURAL JOIN numbers m)", 5),
        ("FROM numbers |> WHERE id > 1 |> SELECT id", 3),
    ],
)
def test_what_queries_may_say(numbers, sql, n):
    result = execute_query(numbers, sql)
    assert result.error is None and result.rows.count() == n


def test_texts_that_plan_the_same_run_once(numbers, tmp_path):
    texts = [
        "SELECT id AS x FROM numbers WHERE id < 3", "select  ID as x\nfrom NUMBERS where id<3", "SELECT n.id AS x FROM numbers AS n WHERE n.id < 3 -- why",
        "SELECT id AS y FROM numbers WHERE id < 3", "SELECT id AS x FROM numbers WHERE id < 4", "SELECT 1 / (id - id) AS z FROM numbers",
        "SELECT 1/(ID-ID) AS z FROM numbers", "SELECT nope FROM numbers",
    ]
    rows = numbers.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "index long, predicted_sql string")
    for chunk in (512, 2):
        folder = tmp_path / f"alike{chunk}"
        got = execute_batch(rows, str(folder), chunk=chunk).collect()
        assert sorted((r["index"] % 8, r["outcome"], r["n_rows"]) for r in got) == sorted(
            [(i, "rows", 3) for i in range(4)] * 3 + [(4, "rows", 4)] * 3 + [(i, "error", 0) for i in (5, 6, 7)] * 3
        )
        found = [(r["sql_key"], r["row_json"]) for r in result_rows(numbers, str(folder)).collect()]
        name = {r["sql_key"]: texts[r["index"] % 8] for r in got}
        for text, column, n in [(texts[0], "x", 3), (texts[1], "x", 3), (texts[2], "x", 3), (texts[3], "y", 3), (texts[4], "x", 4)]:
            assert sorted(j for k, j in found if name[k] == text) == ['{"%s":%d}' % (column, i) for i in range(n)]
        runs = [p for p in (folder / "rows").iterdir() if p.name.startswith("run_key=") and list(p.glob("*.parquet"))]
        assert len(runs) == 2 if chunk == 512 else len(runs) <= 4


def test_words_of_refused_functions_in_texts(numbers):
    sql = "SELECT 'reflect(1)' AS a, \"java_method(2)\" AS b -- reflect(3)\nFROM numbers"
    assert execute_query(numbers, sql).rows.count() == 5


def test_json_rows(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a, NULL AS `b``c`, 'x' AS A")
    assert json.loads(as_json_rows(df).first()["row_json"]) == {"a": 1, "a_2": 2, "b`c": None, "A_3": "x"}


def test_batch(numbers, tmp_path):
    texts = [
        "SELECT id FROM numbers WHERE id < 3",
        "SELECT id FROM numbers WHERE id < 0",
        "SELECT * FROM missing",
        "SELECT 1 / (id - id) FROM numbers",
        "",
    ]
    rows = numbers.range(1000).select(
        F.col("id").alias("index"),
        F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 5 + 1).cast("int")).alias("predicted_sql"),
    )
    folder = str(tmp_path / "executed")
    for part in (rows.where("index < 503"), rows, rows):
        got = execute_batch(part, folder, chunk=2).orderBy("index").collect()
    want = {0: ("rows", 3), 1: ("empty", 0), 2: ("error", 0), 3: ("error", 0)}
    assert len(got) == 800
    for row in got:
        assert (row["outcome"], row["n_rows"]) == want[row["index"] % 5]
        assert (row["error"] is not None) == (row["outcome"] == "error")
    errors = {row["index"] % 5: row["error"] for row in got if row["error"]}
    assert "TABLE_OR_VIEW_NOT_FOUND" in errors[2] and "DIVIDE_BY_ZERO" in errors[3]
    stored = result_rows(numbers, folder)
    assert sorted(r["row_json"] for r in stored.collect()) == ['{"id":0}', '{"id":1}', '{"id":2}']
    assert numbers.read.parquet(f"{folder}/outcomes").count() == 4


def test_one_database_per_question(spark, tmp_path):
    for db in ("left_db", "right_db"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
        spark.createDataFrame([(db,)], "name string").write.mode("overwrite").saveAsTable(f"{db}.t")
    rows = spark.createDataFrame(
        [(0, "left_db", "SELECT * FROM t"), (1, "right_db", "SELECT * FROM t"), (2, "no_db", "SELECT * FROM t")],
        "index long, db_id string, predicted_sql string",
    )
    folder = str(tmp_path / "executed")
    outcomes = execute_batch(rows, folder, by_database=True).orderBy("index").collect()
    assert [r["outcome"] for r in outcomes] == ["rows", "rows", "error"]
    assert sorted(r["row_json"] for r in result_rows(spark, folder).collect()) == [
        '{"name":"left_db"}', '{"name":"right_db"}',
    ]


STORE_TABLES = {
    "customers": "customer_id INTEGER PRIMARY KEY AUTOINCREMENT, first_name VARCHAR(50) NOT NULL, created_at TEXT DEFAULT CURRENT_TIMESTAMP",
    "products": "product_id INTEGER PRIMARY KEY AUTOINCREMENT, name VARCHAR(100) NOT NULL, price DECIMAL(10,2) NOT NULL",
    "orders": "order_id INTEGER PRIMARY KEY AUTOINCREMENT, customer_id INTEGER, total_amount DECIMAL(10,2), FOREIGN KEY (customer_id) REFERENCES customers(customer_id)",
}
STORE_ROWS = {
    "customers": [f"({i}, 'First{i}', '2025-07-23 16:24:19')" for i in range(1, 51)],
    "products": [f"({i}, 'Product {i}', {20 * i}.{i % 100:02d})" for i in range(1, 51)],
    "orders": [f"({i}, {(i - 1) % 20 + 1}, {i}.50)" for i in range(1, 51)],
}
# What the demo asks, the SQL a model would give, and the number of rows expected.
DEMO = [
    ("List all customers", "SELECT * FROM customers", 50),
    ("Show orders for customer with id 5", "SELECT * FROM orders WHERE customer_id = 5", 3),
    ("Find expensive products over $100", "SELECT * FROM products WHERE price > 100", 46),
]


def demo_model(settings):
    answers = {question: sql for question, sql, _ in DEMO}

    def ask(prompts):
        asked = [p.split("QUESTION: ")[1].split("\n")[0] for p in prompts]
        return ['result={"sql_query": "%s", "summary": "%s"}' % (answers[q], q) for q in asked]

    return ask


def test_demo_questions(spark, tmp_path):
    text = "-- A store; three tables\n"
    for name, columns in STORE_TABLES.items():
        names = ", ".join(c.split()[0] for c in columns.split(", ") if not c.startswith("FOREIGN"))
        text += f"DROP TABLE IF EXISTS {name};\nCREATE TABLE {name} (\n  {columns}\n);\n\n"
        text += f"-- the {name}' rows\nINSERT INTO {name} ({names}) VALUES\n" + ",\n".join(STORE_ROWS[name]) + ";\n\n"
    path = tmp_path / "store.sql"
    path.write_text(text)
    loaded, docs = open_dump(spark, str(path))
    assert {n: t.count() for n, t in loaded.tables.items()} == dict.fromkeys(STORE_TABLES, 50)
    assert [d["doc"].split(" (")[0] for d in docs.orderBy("doc_no").collect()] == [
        f"CREATE TABLE {name}" for name in STORE_TABLES
    ]
    for question, sql, n in DEMO:
        answer = ask(spark, question, docs, demo_model, lambda settings: lambda prompts: ["VALID"] * len(prompts))
        assert (answer.sql, answer.summary, answer.reviewed, answer.rows.count()) == (sql, question, True, n)

    samples = spark.createDataFrame(
        [(i, "dump", q, "") for i, (q, _, _) in enumerate(DEMO)], "index long, db_id string, question string, query string"
    )
    rows = answer_batch(samples, docs, str(tmp_path / "answers"), demo_model).orderBy("index").collect()
    assert [(r["outcome"], r["n_rows"]) for r in rows] == [("rows", n) for _, _, n in DEMO]


SHOP = """
CREATE TABLE products (id INTEGER PRIMARY KEY, name VARCHAR(9), price DECIMAL(10,2));
INSERT INTO products VALUES (1, 'pen', 1.5), (2, 'car', 2000), (3, 'bike', 300.25);
"""


def shop_model(settings):
    def ask(prompts):
        out = []
        for p in prompts:
            assert p.startswith("You are a Spark SQL expert.") and "CREATE TABLE products" in p
            if "expensive" in p:
                out.append('```json\n{"sql_query": "SELECT name FROM products WHERE price > 100", "summary": "dear"}\n```')
            elif "broken" in p:
                out.append("SELECT nothing FROM nowhere")
            elif "silent" in p:
                out.append("")
            else:
                raise ValueError("what?")
        return out

    return ask


def ordering_reviewer(settings):
    def ask(prompts):
        answers = []
        for p in prompts:
            sql = p.split("Generated SQL Query:\n")[1].split("\n\nPlease")[0]
            answers.append("VALID" if "ORDER BY" in sql or "nowhere" in sql else f"FIXED: {sql} ORDER BY name")
        return answers

    return ask


def test_ask(spark, tmp_path):
    path = tmp_path / "shop.sql"
    path.write_text(SHOP)
    loaded, docs = open_dump(spark, str(path))
    assert list(loaded.tables) == ["products"] and loaded.rejects.count() == 0

    answer = ask(spark, "Find expensive products", docs, shop_model, ordering_reviewer)
    assert (answer.sql, answer.summary, answer.reviewed, answer.error) == (
        "SELECT name FROM products WHERE price > 100 ORDER BY name", "dear", True, None,
    )
    assert [r["name"] for r in answer.rows.collect()] == ["bike", "car"]

    plain = ask(spark, "Find expensive products", docs, shop_model)
    assert plain.rows.count() == 2 and not plain.reviewed
    broken = ask(spark, "broken", docs, shop_model, ordering_reviewer)
    assert broken.rows is None and "nowhere" in broken.error
    silent = ask(spark, "silent", docs, shop_model)
    assert silent.error == "SQL generation failed: Could not extract SQL from response: "
    assert ask(spark, "other", docs, shop_model).error == "SQL generation failed: what?"
    assert ask(spark, " ", docs, shop_model).error == "Missing question in sample."
