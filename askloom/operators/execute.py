"""Execution of generated SQL, one query or a whole prediction table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby, islice

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..storage import broadcast_if_small, new_folder, read_or_empty, remove_folder, written
from .guard import refuse_unknown
from .joins import lookup_join

# What stands before the text of a failure.
EXECUTION_ERROR = "Execution error: "

OUTCOMES = "db_id string, sql string, sql_key string, n_rows long, error string, run_key string, variant int"
PLANNED = "db_id string, sql string, sql_key string, plan long, error string"
STORED_ROWS = "row_json string, variant int, run_key string"


# Quoted texts, what may stand after the end of a query, and anything else.
PARTS = re.compile(
    r"(?s)'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|(?P<after>--[^\n]*|/\*.*?\*/|;|\s)|."
)


@dataclass
class QueryResult:
    """Rows of a query, or why there are none."""

    rows: DataFrame | None
    error: str | None = None


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of any query form. What is not a query is refused and has no effect.

    The text must also stand as a subquery: that admits WITH, VALUES and ORDER BY,
    while statements that change tables do not parse there and are never run. Queries
    may read the session's tables and views and nothing else; see ``guard``.
    """
    ends = [part.end() for part in PARTS.finditer(sql) if not part["after"]]
    text = sql[: ends[-1]].lstrip(WHITESPACE) if ends else ""
    refuse_unknown(spark, f"SELECT * FROM (\n{text}\n)")
    spark.sql(f"SELECT * FROM (\n{text}\n)")
    return spark.sql(text)


def _distinct_names(names: list[str]) -> list[str]:
    """The names, a repeated one with its number."""
    seen: dict[str, int] = {}
    found = []
    for name in names:
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        found.append(name if n == 1 else f"{name}_{n}")
    return found


def _written_in_order(rows: DataFrame) -> DataFrame:
    """``rows`` written once, read back in their order; a repeated column name gets a number."""
    names = _distinct_names(rows.columns)
    plain = rows.toDF(*names)
    odd = {f.name: F.col("`%s`" % f.name.replace("`", "``")).cast("string") for f in plain.schema if f.dataType.typeName() in ("void", "interval")}
    placed = plain.withColumns(odd).withColumn("__place", F.monotonically_increasing_id())
    return written(placed, "query-rows").orderBy("__place").drop("__place")


def execute_query(spark: SparkSession, sql: str, lazy: bool = False) -> QueryResult:
    """Run one query; a failure becomes an error value, also one that some value causes.

    The query runs here, once, and its rows are written; the result reads them back in
    their order. With ``lazy`` the rows are the query itself: it runs where they are
    used, and what fails only on some value fails there.
    """
    try:
        rows = query(spark, sql)
        return QueryResult(rows if lazy else _written_in_order(rows))
    except PySparkException as problem:
        return QueryResult(None, f"{EXECUTION_ERROR}{problem}")


def _plain_names(names: list[str]) -> list[str]:
    return [f"c{i}" for i in range(len(names))]


def _json_row(columns: list[str], names: list[str]) -> Column:
    """A JSON object of some columns under other names, nulls kept."""
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
    return F.to_json(row, {"ignoreNullFields": "false"})


def as_json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept; a repeated column name gets a number."""
    names = _distinct_names(rows.columns)
    plain = _plain_names(names)
    return rows.toDF(*plain).select(_json_row(plain, names).alias("row_json"))


def sql_key(db_id: Column, sql: Column) -> Column:
    """A name for a text in a database, under which its rows are kept."""
    return F.sha2(F.concat(db_id, F.lit("\n"), sql), 256)


def _session(spark: SparkSession, db_id: str, by_database: bool) -> SparkSession:
    if not by_database:
        return spark
    session = spark.newSession()
    session.catalog.setCurrentDatabase(db_id)
    return session


def _planned(spark: SparkSession, text: Row, by_database: bool) -> tuple:
    """A text with a hash of its plan, or why it has none. Nothing runs."""
    db_id, sql, key = text["db_id"], text["sql"], text["sql_key"]
    try:
        return db_id, sql, key, query(_session(spark, db_id, by_database), sql).semanticHash(), None
    except PySparkException as problem:
        return db_id, sql, key, None, f"{EXECUTION_ERROR}{problem}"


def _run_alike(spark: SparkSession, texts: list[Row], folder: str, by_database: bool) -> list[tuple]:
    """Run texts whose plans have one hash: one job for all whose plans are the same.

    Plans are compared without the names in them, so texts that differ in spacing, case or
    aliases are run once. The rows are kept for each set of column names among them.
    """
    alike: list[tuple[DataFrame, list[tuple[Row, tuple[str, ...]]]]] = []
    done = []
    for text in texts:
        try:
            rows = query(_session(spark, text["db_id"], by_database), text["sql"])
        except PySparkException as problem:  # it had a plan before: what it reads has changed
            done.append((text["db_id"], text["sql"], text["sql_key"], 0, f"{EXECUTION_ERROR}{problem}", None, None))
            continue
        own = (text, tuple(_distinct_names(rows.columns)))
        same = next((members for first, members in alike if first.sameSemantics(rows)), None)
        if same is None:
            alike.append((rows, [own]))
        else:
            same.append(own)
    for rows, members in alike:
        run_key = members[0][0]["sql_key"]
        variants = list(dict.fromkeys(names for _, names in members))
        n_rows, error = 0, None
        try:
            counted, plain = Observation(), _plain_names(rows.columns)
            seen = rows.toDF(*plain).observe(counted, F.count(F.lit(1)).alias("n"))
            each = [F.struct(_json_row(plain, list(names)).alias("row_json"), F.lit(i).alias("variant")) for i, names in enumerate(variants)]
            seen.select(F.inline(F.array(*each))).write.mode("overwrite").parquet(f"{folder}/rows/run_key={run_key}")
            n_rows = counted.get["n"]
        except PySparkException as problem:
            error = f"{EXECUTION_ERROR}{problem}"
        done += [
            (text["db_id"], text["sql"], text["sql_key"], n_rows, error, run_key, variants.index(names)) for text, names in members
        ]
    return done


def _chunks(rows: Iterator, size: int) -> Iterator[list]:
    while chunk := list(islice(rows, size)):
        yield chunk


def execute_batch(
    predictions: DataFrame,
    folder: str,
    sql: str = "predicted_sql",
    concurrency: int = 8,
    chunk: int = 512,
    by_database: bool = False,
) -> DataFrame:
    """Run the SQL of each row: (index, sql_key, outcome, n_rows, error).

    Equal texts are run once, and so are texts that Spark plans the same, such as those that differ
    in spacing, case or aliases. Each query is a Spark job of its own that writes its
    rows below ``folder`` (see ``result_rows``) and counts them on the way, so no
    result passes the driver and none is read again. The driver plans the distinct texts
    in turn, ``chunk`` at a time, sorts them by their plans, runs them, and notes what became of them;
    texts noted by an earlier run into the same folder are skipped. One job per distinct plan is the
    ceiling; more than ``chunk`` spellings of one take several.
    With ``by_database`` each text runs in the database named by its row.

    Outcomes are ``rows``, ``empty`` and ``error``; one failure stops nothing else.
    """
    spark = predictions.sparkSession
    db = F.col("db_id") if by_database else F.lit("")
    wanted = predictions.where(F.col(sql) != "").select(
        "index", db.alias("db_id"), F.col(sql).alias("sql")
    )
    wanted = wanted.withColumn("sql_key", sql_key(F.col("db_id"), F.col("sql")))
    # Read several times below, and the predictions may come straight from a model.
    wanted = written(wanted, "texts-to-run")
    noted = read_or_empty(spark, f"{folder}/outcomes", OUTCOMES)
    texts = wanted.select("db_id", "sql", "sql_key").distinct()
    pending = texts.join(noted.select("sql_key"), "sql_key", "left_anti")
    plans = new_folder(spark, "planned-texts")

    def note(done: list[tuple], schema: str, place: str) -> None:
        spark.createDataFrame(done, schema).coalesce(1).write.mode("append").parquet(place)

    with ThreadPoolExecutor(concurrency) as pool:
        for some in _chunks(pending.toLocalIterator(), chunk):
            note(list(pool.map(lambda text: _planned(spark, text, by_database), some)), PLANNED, plans)
        planned = read_or_empty(spark, plans, PLANNED)
        no_run = [F.lit(0).cast("long").alias("n_rows"), "error", F.lit(None).cast("string").alias("run_key"), F.lit(None).cast("int").alias("variant")]
        unplanned = planned.where("error IS NOT NULL").select("db_id", "sql", "sql_key", *no_run)
        if not unplanned.isEmpty():
            unplanned.write.mode("append").parquet(f"{folder}/outcomes")
        ordered = planned.where("error IS NULL").orderBy("db_id", "plan", "sql_key")
        for some in _chunks(ordered.toLocalIterator(), chunk):
            groups = [list(g) for _, g in groupby(some, key=lambda text: (text["db_id"], text["plan"]))]
            done = pool.map(lambda group: _run_alike(spark, group, folder, by_database), groups)
            note([row for rows in done for row in rows], OUTCOMES, f"{folder}/outcomes")
    remove_folder(spark, plans)

    noted = read_or_empty(spark, f"{folder}/outcomes", OUTCOMES)
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("n_rows") == 0, "empty").otherwise("rows")
    )
    outcomes = noted.select("sql_key", outcome.alias("outcome"), "n_rows", "error")
    # Many questions may share one text, so this join must bear a hot key.
    return lookup_join(wanted.select("index", "sql_key"), outcomes, "sql_key", "index").select(
        "index", "sql_key", "outcome", "n_rows", "error"
    )


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(sql_key, row_json) of all results that ``execute_batch`` wrote below ``folder``.

    Texts that were run as one have the rows each, under their own column names.
    """
    stored = read_or_empty(spark, f"{folder}/rows", STORED_ROWS)
    texts = read_or_empty(spark, f"{folder}/outcomes", OUTCOMES).where("run_key IS NOT NULL AND error IS NULL")
    keys = written(texts.select("run_key", "variant", "sql_key"), "run-keys")
    return stored.join(broadcast_if_small(keys), ["run_key", "variant"]).select("row_json", "sql_key")
