"""Model calls, prediction tables, whole jobs and the stream."""

import itertools
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from askloom.functions.replies import parse_verdict, review_fold
from askloom.operators import catalog
from askloom.operators.model import GENERATION, generate_batch, packed, predict
from askloom.operators.report import preview, run_report
from askloom.operators.review import review
from askloom.plans.generate import _parts, run_batch, schema_of_databases
from askloom.sources import finished
from askloom.sources import predictions as table
from askloom.storage import remove_folder
from askloom.streaming.predict import read_question_stream, stream_predictions


def echo_model(settings):
    def ask(prompts):
        return [
            '{"sql_query": "SELECT %d, %s"}' % (settings.max_tokens, p.split("QUESTION: ")[1].split("\n")[0])
            for p in prompts
        ]

    return ask


def picky_model(settings):
    def ask(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("bad prompt")
        return ["re " + p for p in prompts]

    return ask


def test_one_bad_prompt_spoils_no_other(spark):
    prompts = [None if i % 7 == 0 else f"{'bad' if i % 5 == 0 else 'ok'} {i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(prompts)), "index long, prompt string")
    rows = generate_batch(df, picky_model, batch_size=16, concurrency=3).collect()
    assert len(rows) == 200
    for row in rows:
        prompt, call = row["prompt"], row["call"]
        if prompt is None:
            assert (call["reply"], call["error"], call["elapsed_sec"]) == (None, None, 0.0)
        elif "bad" in prompt:
            assert (call["reply"], call["error"]) == (None, "bad prompt")
        else:
            assert (call["reply"], call["error"]) == ("re " + prompt, None)


def test_batches_are_bounded_by_bytes(spark):
    sizes = [5, 5, 5, 100, 1, 9, 10, 11, 0, 0, 0, 3]
    runs = [list(r) for r in packed(sizes, 3, 10)]
    assert [i for r in runs for i in r] == list(range(len(sizes)))
    assert all(len(r) <= 3 and (len(r) == 1 or sum(sizes[i] for i in r) <= 10) for r in runs)
    assert all(len(a) == 3 or sum(sizes[i] for i in [*a, b[0]]) > 10 for a, b in zip(runs, runs[1:]))
    assert list(packed([], 3, 10)) == []

    def counting(settings):
        return lambda prompts: [f"{len(prompts)} {sum(len(p.encode()) for p in prompts)}" for _ in prompts]

    prompts = [None if i == 7 else "é" * 40_000 if i == 11 else f"prompt {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(prompts)), "index long, prompt string").coalesce(1)
    for r in generate_batch(df, counting, batch_size=16, batch_bytes=50).collect():
        if r["prompt"] is not None:
            n, size = map(int, r["call"]["reply"].split())
            assert (n == 1 and size == 80_000) if r["index"] == 11 else (1 < n <= 6 and size <= 50) or r["index"] in (10, 59)


def test_model_that_cannot_be_opened(spark):
    def broken(settings):
        raise OSError("no server")

    df = spark.createDataFrame([(1, "p"), (2, "q")], "index long, prompt string")
    assert [r["call"]["error"] for r in generate_batch(df, broken).collect()] == ["no server"] * 2


def test_settings():
    assert (GENERATION.temperature, GENERATION.max_tokens) == (0.3, 500)


def test_each_prompt_is_sent_once(spark, tmp_path):
    folder = str(tmp_path)

    def counting(settings):
        import uuid

        def ask(prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(prompts))
            return ["SELECT 1" for _ in prompts]

        return ask

    questions = spark.range(0, 100, 1, 4).select(
        F.col("id").alias("index"), F.lit("d").alias("db_id"), F.concat(F.lit("q"), "id").alias("question"),
        F.lit("").alias("gold_sql"), F.lit("T").alias("schema_text"), F.lit(True).alias("has_schema_file"),
        F.lit("ok").alias("status"), F.lit("").alias("error"),
    )
    done = predict(questions, counting).where("status = 'ok' AND predicted_sql = 'SELECT 1'")
    assert done.count() == 100
    sent = sum(p.read_text().count("QUESTION: ") for p in tmp_path.iterdir())
    assert sent == 100


def scripted_reviewer(settings):
    """The question says what the reviewer answers in each round, by what the SQL has become."""

    def ask(prompts):
        answers = []
        for p in prompts:
            script = json.loads(p.split("User Question:\n")[1].split("\n\nGenerated")[0])
            sql = p.split("Generated SQL Query:\n")[1].split("\n\nPlease")[0]
            answers.append(script.get(sql, "INVALID"))
        return answers

    return ask


def test_review(spark):
    cases = [
        ({"a": "VALID"}, "a", True),
        ({"a": "FIXED: b", "b": "VALID"}, "b", True),
        ({"a": "FIXED: b", "b": "FIXED: c", "c": "FIXED: d", "d": "VALID"}, "d", False),
        ({"a": "```\nFIXED: b\n```", "b": "```VALID```"}, "b", True),
        ({"a": "```sql\nFIXED: b\n```"}, "a", False),
        ({}, "a", False),
        ({"a": ""}, "a", False),
        ({"a": "FIXED:", "": "FIXED: b", "b": "VALID"}, "b", True),
    ]
    df = spark.createDataFrame(
        [(i, json.dumps(s), "T", "a") for i, (s, _, _) in enumerate(cases)],
        "index long, question string, schema_text string, predicted_sql string",
    )
    rows = review(df, scripted_reviewer).orderBy("index").collect()
    assert [(r["sql"], r["reviewed"]) for r in rows] == [(sql, ok) for _, sql, ok in cases]


def test_review_is_its_replay(spark):
    """Live and replayed, whatever the reviewer says to each SQL there can be."""
    answers = ["VALID", "FIXED:", "FIXED: b", "INVALID", ""]
    scripts = [dict(zip(["a", "", "b"], s)) for s in itertools.product(answers, repeat=3)]
    said = []
    for script in scripts:
        sql, turns = "a", []
        for _ in range(3):
            turns.append(script[sql])
            sql = turns[-1][7:] if turns[-1].startswith("FIXED:") else sql
        said.append(turns)
    rows = spark.createDataFrame(
        [(i, json.dumps(s), "T", "a", t) for i, (s, t) in enumerate(zip(scripts, said))],
        "index long, question string, schema_text string, predicted_sql string, replies array<string>",
    )
    live = {r["index"]: (r["sql"], r["reviewed"]) for r in review(rows, scripted_reviewer).collect()}
    replay = review_fold(F.col("predicted_sql"), F.transform("replies", parse_verdict))
    again = rows.select("index", replay.alias("r")).collect()
    assert live == {r["index"]: (r["r"]["sql"], r["r"]["reviewed"]) for r in again}


def test_reviewer_that_fails(spark):
    def broken(settings):
        raise OSError("gone")

    df = spark.createDataFrame([("q", "T", "a")], "question string, schema_text string, predicted_sql string")
    row = review(df, broken).first()
    assert (row["sql"], row["reviewed"]) == ("a", False)


@pytest.fixture()
def root(tmp_path):
    """A question set over three databases with dumps, one without tables."""
    dumps = {
        "shop": "CREATE TABLE items (id INT);\nINSERT INTO items VALUES (1);\nCREATE TABLE sales (id INT);\n",
        "a+b é": "CREATE TABLE plus (id INT);\n",
        "zoo": "-- no tables; it's empty\nDROP TABLE x;\n",
    }
    for db, text in dumps.items():
        (tmp_path / "database" / db).mkdir(parents=True)
        (tmp_path / "database" / db / "schema.sql").write_text(text)
        (tmp_path / "database" / db / "other.sql").write_text("CREATE TABLE wrong (id INT);\n")
    return tmp_path


def samples(spark, n=10):
    dbs = ["shop", "zoo", "gone", ""]
    rows = [(i, dbs[i % 4], f" q{i} ", "") for i in range(n)]
    return spark.createDataFrame(rows, "index long, db_id string, question string, query string")


def test_schema_of_databases(spark, root):
    store = str(root / "store")
    asked = samples(spark).union(spark.sql("SELECT 99L, 'a+b é', 'q', ''"))
    for refresh in (False, False, True):
        got = schema_of_databases(asked, str(root), store, refresh).orderBy("db_id").collect()
        assert [tuple(r) for r in got] == [
            ("a+b é", "CREATE TABLE plus (id INT);"),
            ("shop", "CREATE TABLE items (id INT);\n\nCREATE TABLE sales (id INT);"),
            ("zoo", None),
        ]


def test_batch_flushes_resumes_and_reports(spark, root):
    out = str(root / "out" / "predictions")
    schemas = schema_of_databases(samples(spark), str(root), str(root / "store"))
    first = run_batch(samples(spark), schemas, out, echo_model, start=1, limit=5, flush_every=2).first()
    assert (first["n_rows"], first["n_ok"], first["n_error"]) == (5, 1, 4)
    report = run_batch(samples(spark), schemas, out, echo_model, resume=True).first()
    assert (report["n_rows"], report["n_ok"], report["n_error"]) == (10, 3, 7)
    again = run_batch(samples(spark), schemas, out, echo_model, resume=True).first()
    assert again["n_rows"] == 10
    rows = table.read_predictions(spark, out).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(10))
    assert [r["predicted_sql"] for r in rows if r["status"] == "ok"] == [f"SELECT 500, q{i}" for i in (0, 4, 8)]
    assert rows[1]["error"] == "No schema available to generate SQL"
    assert rows[2]["error"] == "Schema SQL not found for db_id='gone'"
    repeated = run_batch(samples(spark), schemas, out, echo_model).first()
    assert repeated["n_rows"] == 20
    with pytest.raises(ValueError, match="No rows selected"):
        run_batch(samples(spark), schemas, out, echo_model, start=10)


def test_errors_can_be_retried(spark, root):
    done = spark.createDataFrame([(1, "ok"), (2, "error"), (None, "ok"), (2, "error")], "index long, status string")
    assert sorted(r[0] for r in table.completed_indices(done).collect()) == [1, 2]
    assert [r[0] for r in table.completed_indices(done, retry_errors=True).collect()] == [1]


def test_no_table_means_nothing_is_done(spark, tmp_path):
    assert table.read_predictions(spark, str(tmp_path / "none")).count() == 0


ROWS = [
    (3, "d", 'say "hi", ok', "", "SELECT 'a\n\"b\"'\n", " s ", "ok", "", 0.5),
    (1, "d", "q" * 121, "g", "x" * 201, "", "ok", "", 1.0),
    (2, "", "", "", "", "", "error", "Missing db_id in sample.", 0.0),
    (0, "d", "q" * 120, "g", "x" * 200, "", "ok", "", 1.5),
]


def test_report_and_preview(spark):
    df = spark.createDataFrame(ROWS, table.PREDICTIONS)
    assert tuple(run_report(df).first()) == (4, 3, 1, 0.75)
    assert run_report(df.limit(0)).first()["n_rows"] == 0
    shown = [tuple(r) for r in preview(df, 2).collect()]
    assert shown == [(0, "d", "q" * 120, "x" * 200), (1, "d", "q" * 120 + "...", "x" * 200 + "...")]
    assert preview(df, 0).count() == 0 and preview(df, -1).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, table.PREDICTIONS)
    path = str(tmp_path / "csv")
    table.export_csv(df, path)
    table.export_csv(df.where("index = 1"), path)
    back = sorted(map(tuple, table.read_csv(spark, path).collect()))
    assert back == sorted([*ROWS, ROWS[1]])


def test_csv_of_other_tools(spark, tmp_path):
    """A table that was begun elsewhere and written by pandas can be gone on with."""
    path, out = tmp_path / "old.csv", str(tmp_path / "table")
    pd.DataFrame(ROWS, columns=table.PREDICTIONS.fieldNames()).to_csv(path, index=False, encoding="utf-8")
    old = table.read_csv(spark, str(path))
    assert sorted(map(tuple, old.collect())) == sorted(ROWS)
    table.append_predictions(old, out)
    assert sorted(r[0] for r in table.completed_indices(table.read_predictions(spark, out)).collect()) == [0, 1, 2, 3]


def doc_rows(spark, *rows):
    df = spark.createDataFrame(list(rows), "db_id string, doc_no int, doc string")
    return df.withColumn("doc_id", F.concat(F.lit("schema_doc_"), "doc_no"))


def test_store_once_or_refresh(spark, tmp_path):
    path = str(tmp_path / "store")
    names = ["007", "b", *[f"db{i}" for i in range(200)]]
    catalog.store_schema_docs(doc_rows(spark, *[(n, 0, "old") for n in names]), path)
    more = doc_rows(spark, ("007", 0, "new"), ("007", 1, "new"), ("c", 0, "new"))
    catalog.store_schema_docs(more, path)
    stored = catalog.read_schema_docs(spark, path)
    assert stored.count() == 203 and stored.where("doc = 'new'").count() == 1
    catalog.store_schema_docs(more, path, refresh=True)
    assert [r["doc"] for r in catalog.read_schema_docs(spark, path, "007").collect()] == ["new", "new"]
    stored = catalog.read_schema_docs(spark, path)
    assert stored.count() == 204 and stored.where("doc = 'old'").count() == 201
    catalog.verify_store(more, stored.where("db_id IN ('007', 'c')"))
    with pytest.raises(ValueError, match="should have 2 stored documents and has 1"):
        catalog.verify_store(more, stored.where("db_id = 'c' OR doc_no = 1"))


def test_docs_are_joined_in_order(spark):
    docs = doc_rows(spark, *[("a", i, f"d{i}") for i in reversed(range(12))], ("b", 0, "x"))
    texts = {r["db_id"]: r["schema_text"] for r in catalog.schema_text_by_db(docs, "|").collect()}
    assert texts == {"a": "|".join(f"d{i}" for i in range(12)), "b": "x"}


def test_stream_takes_each_question_once(spark, tmp_path):
    lines, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schemas = spark.createDataFrame([("d", "T")], "db_id string, schema_text string")

    def add(part, numbers):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text(
            "\n".join(json.dumps({"index": i, "db_id": "d", "question": f"q{i}"}) for i in numbers)
        )

    def run(**options):
        stream = read_question_stream(spark, lines)
        stream_predictions(stream, schemas, out, check, echo_model, **options).awaitTermination()
        return sorted(r["index"] for r in table.read_predictions(spark, out).collect())

    add("a", range(5))
    add("b", range(5, 8))
    assert run() == list(range(8))
    assert run() == list(range(8))
    add("c", range(6, 12))
    assert run(resume=True) == list(range(12))


def noted(spark, out, indices):
    questions = spark.createDataFrame([(i, "d") for i in indices], "index long, db_id string")
    return sorted(str(r["index"]) for r in finished.without_finished(questions, out).collect())


def test_finished_indices(spark, tmp_path):
    out = str(tmp_path / "out")
    asked = [0, 1, -1, -5, 32768, 32769, 65536, 10**12, None]

    def write(folder, rows):
        df = spark.createDataFrame([(i, "error" if bad else "ok") for i, bad in rows], "index long, status string")
        df.write.mode("overwrite").parquet(f"{out}/{folder}")

    assert noted(spark, out, asked) == sorted(map(str, asked))
    write("stream_a/batch_0", [(0, False), (32768, True), (10**12, False), (None, False)])
    finished.note_finished(spark, out, "stream_a", 0, "stream_a/batch_0")
    left = [1, -1, -5, 32769, 65536, None]
    assert noted(spark, out, asked) == sorted(map(str, left))
    # not noted, since the writer broke off: read from the rows
    write("stream_a/batch_1", [(1, False)])
    write("run_b/batch_0", [(-5, False)])
    assert noted(spark, out, asked) == sorted(map(str, [-1, 32769, 65536, None]))
    # the same batch again does not count its own rows, noted or not
    questions = spark.createDataFrame([(i, "d") for i in asked], "index long, db_id string")
    again = finished.without_finished(questions, out, repeats=("stream_a", 1))
    assert sorted(str(r["index"]) for r in again.collect()) == sorted(map(str, [1, -1, 32769, 65536, None]))
    finished.note_finished(spark, out, "stream_a", 1, "stream_a/batch_1")
    assert sorted(str(r["index"]) for r in finished.without_finished(questions, out, repeats=("stream_a", 1)).collect()) == sorted(
        map(str, [1, -1, 32769, 65536, None])
    )
    assert noted(spark, out, asked) == sorted(map(str, [-1, 32769, 65536, None]))
    retried = finished.without_finished(questions, out, retry_errors=True).collect()
    assert sorted(str(r["index"]) for r in retried) == sorted(map(str, [-1, 32768, 32769, 65536, None]))
    assert table.read_predictions(spark, out).count() == 6


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    out, sizes = str(tmp_path / "out"), []
    for batch in range(12):
        indices = range(batch * 50, batch * 50 + 50)
        questions = spark.createDataFrame([(i, "d") for i in indices], "index long, db_id string")
        read = finished._newest(spark, out, finished.segments_of(questions))
        sizes.append(sum(p.stat().st_size for f in read for p in (tmp_path / "out.finished").joinpath(f.split("/out.finished/")[1]).glob("*.parquet")))
        assert finished._unnoted(spark, out) == [] and finished.without_finished(questions, out).count() == 50
        folder = finished.runs_folder("stream_a", batch)
        questions.selectExpr("index", "'ok' AS status", "'a long text' AS question").write.parquet(f"{out}/{folder}")
        finished.note_finished(spark, out, "stream_a", batch, folder)
    assert len(list((tmp_path / "out.finished").glob("*/segment=*/batch=*"))) <= 4
    assert sizes[0] == 0 and max(sizes[2:]) < 1.5 * sizes[2]
    assert noted(spark, out, range(605)) == sorted(map(str, range(600, 605)))


def test_a_fresh_checkpoint_at_an_old_path_overwrites_nothing(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    schemas = spark.createDataFrame([("d", "T")], "db_id string, schema_text string")
    for part in (range(3), range(10, 14)):
        lines = tmp_path / f"in{part.start}"
        lines.mkdir()
        (lines / "a.json").write_text("\n".join(json.dumps({"index": i, "db_id": "d", "question": "q"}) for i in part))
        stream = read_question_stream(spark, str(lines))
        stream_predictions(stream, schemas, out, check, echo_model).awaitTermination()
        remove_folder(spark, check)
    found = table.read_predictions(spark, out)
    assert sorted(r["index"] for r in found.collect()) == [0, 1, 2, 10, 11, 12, 13]


def test_questions_without_an_index_are_reported(spark, root):
    out = str(root / "out" / "predictions")
    schemas = schema_of_databases(samples(spark), str(root), str(root / "store"))
    rows = [(0, "shop", "q", ""), (None, "shop", "q", ""), (-4, "shop", "q", "")]
    asked = spark.createDataFrame(rows, "index long, db_id string, question string, query string")
    report = run_batch(asked, schemas, out, echo_model).first()
    assert (report["n_rows"], report["n_ok"], report["n_error"]) == (3, 1, 2)
    report = run_batch(asked, schemas, out, echo_model, resume=True, flush_every=2).first()
    assert (report["n_rows"], report["n_ok"], report["n_error"]) == (4, 1, 3)
    errors = {r["index"]: r["error"] for r in table.read_predictions(spark, out).where("status = 'error'").collect()}
    assert errors == {None: "Missing index in sample.", -4: "Missing index in sample."}


def test_flush_counts_rows_not_indices(spark, root):
    out = root / "out" / "predictions"
    schemas = schema_of_databases(samples(spark), str(root), str(root / "store"))
    asked = samples(spark, 7).withColumn("index", F.col("index") * F.col("index") * 1000)
    assert [p.count() for p in _parts(asked, 3)] == [3, 3, 1]
    assert [p.count() for p in _parts(asked.limit(0), 3)] == []
    sparse = samples(spark, 2).withColumn("index", F.col("index") * 2000)
    assert run_batch(sparse, schemas, str(out), echo_model, flush_every=25).first()["n_rows"] == 2
    assert len(list(out.glob("**/*.parquet"))) <= 2
