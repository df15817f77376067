"""Statements of a dump that make rows from rows: INSERT .. SELECT and CREATE TABLE .. AS SELECT.

Each sees the tables as its place in the dump leaves them: the rows of the statements before it that no
constraint has refused. Their queries run as Spark SQL under the guard of ``query``, many to a job. A later
one may read what an earlier one has made: those that read no table written before them run first, the
others in windows, in order. A window's statements all see what was there before it; once its rows are
judged, those count before which nothing has changed in any table they read, and the others run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .execute import query

_NAME = r"(?:[`\"]?\w+[`\"]?\.)?[`\"]?\w+[`\"]?"
_QUERY = r"\(*\s*(?:select|with)\b"
_INTO = r"(?isU)^insert\s+into\s+" + _NAME + r"\s*(\((?!\s*(?:select|with)\b)[^()]*\))?\s*"
_AS = r"(?isU)^create\s+table\s+(if\s+not\s+exists\s+)?" + _NAME + r"\s*(?:as\s+)?"

INSERT_SELECT, CREATE_AS = "insert_select", "create_as"


def is_insert_select(stmt: Column) -> Column:
    return stmt.rlike(_INTO + _QUERY)


def is_create_as(stmt: Column) -> Column:
    return stmt.rlike(_AS + _QUERY)


def derived_statements(apart: DataFrame) -> DataFrame:
    """(path, stmt_no, part_no, kind, table_name, list, spares, sql, stmt) in the dump's order.

    ``list`` holds the columns an INSERT names, ``spares`` whether a CREATE bears that its table exists.
    """
    stmt, is_insert = F.col("stmt"), F.col("kind") == INSERT_SELECT
    head = F.when(is_insert, F.regexp_extract(stmt, _INTO, 0)).otherwise(F.regexp_extract(stmt, _AS, 0))
    found = apart.where(F.col("kind").isin(INSERT_SELECT, CREATE_AS)).withColumn("head", head)
    names = F.lower(F.regexp_replace(F.regexp_extract(stmt, _INTO, 1), r"[()`\"\s]", ""))
    return found.select(
        "path",
        "stmt_no",
        "part_no",
        "kind",
        F.col("for_table").alias("table_name"),
        F.when(is_insert, F.nullif(names, F.lit(""))).alias("list"),
        (F.regexp_extract(stmt, _AS, 1) != "").alias("spares"),
        F.expr("substring(stmt, length(head) + 1)").alias("sql"),
        "stmt",
    ).orderBy("path", "stmt_no", "part_no")


def before(statement: Row, prefix: str = "__") -> Column:
    """Whether a row (``__path`` and so on) comes before a statement."""
    own = F.struct(*[F.col(prefix + c) for c in ("path", "stmt_no", "part_no")])
    return own < F.struct(
        F.lit(statement["path"]), F.lit(statement["stmt_no"]).cast("long"), F.lit(statement["part_no"]).cast("int")
    )


def first_change(old: DataFrame, new: DataFrame, since: Row) -> tuple | None:
    """The place of the first statement, from ``since`` on, whose rows in two states of a table differ."""
    ids = [f"__{c}" for c in ("path", "stmt_no", "part_no")]

    def marked(rows: DataFrame, sign: int) -> DataFrame:
        own = F.to_json(F.struct(*_own(rows)), {"ignoreNullFields": "false"})
        return rows.where(~before(since)).select(*ids, own.alias("row"), F.lit(sign).alias("sign"))

    both = marked(old, 1).unionByName(marked(new, -1)).groupBy(*ids, "row").agg(F.sum("sign").alias("n"))
    first = both.where("n <> 0").agg(F.min(F.struct(*ids)).alias("at")).first()["at"]
    return None if first is None else tuple(first)


def _own(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")]


def selected_rows(
    session: SparkSession, statement: Row, names: set[str], seen: Callable[[str], DataFrame]
) -> DataFrame:
    """What the statement's query gives, with the rows' places; it is not run yet.

    ``seen`` gives the accepted rows of a table, with their places, in ``session``. While the query is
    resolved the session knows the tables in ``names``, as they are before the statement, and no others,
    so that neither its views nor the caller's are in each other's way.
    """
    try:
        for name in sorted(names):
            path, stmt_no, part_no = F.col("__path"), statement["stmt_no"], statement["part_no"]
            here = F.expr(f"__stmt_no < {stmt_no}L OR (__stmt_no = {stmt_no}L AND __part_no < {part_no})")
            rows = seen(name).where((path <= statement["path"]) & ((path < statement["path"]) | here))
            rows.select(*_own(rows)).createOrReplaceTempView(name)
        found = query(session, statement["sql"])
    finally:
        for name in names:
            session.catalog.dropTempView(name)
    if len({c.lower() for c in found.columns}) < len(found.columns):
        raise PySparkException(message="a column name is repeated.")
    places = {
        "__path": F.lit(statement["path"]),
        "__stmt_no": F.expr(f"{statement['stmt_no']}L"),
        "__part_no": F.expr(f"{statement['part_no']}"),
        "__row_no": F.monotonically_increasing_id(),
    }
    return found.withColumns(places)
