"""Rows of SQL dumps as typed tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.ddl import LITERAL, statement_kind, strip_comments, table_name
from ..functions.text import strip
from ..storage import new_folder, written
from .derived import (
    CREATE_AS, INSERT_SELECT, before, derived_statements, first_change, is_create_as, is_insert_select, selected_rows,
)
from .guard import relations
from .keys import without_repeats


def _parenthesised(depth: int) -> str:
    """Balanced parentheses up to a depth; those inside texts do not count."""
    inner = r"(?:[^'\"()]++|" + LITERAL + r")*+"
    for _ in range(depth - 1):
        inner = r"(?:[^'\"()]++|" + LITERAL + r"|\(" + inner + r"\))*+"
    return r"\(" + inner + r"\)"


NESTING = 3  # of parentheses in a tuple that columns read; deeper ones are read in Python
_NESTED = _parenthesised(NESTING)
_PART = r"(?:[^'\"()]++|" + LITERAL + r")*+"
_DEEPER = r"\(" + (_PART + r"\(") * NESTING
_NAME = r"(?:[`\"]?\w+[`\"]?\.)?[`\"]?\w+[`\"]?"
_CONSTRAINT = (
    r"(?isU)^(?:constraint\s|primary\s+key|foreign\s+key|check\s*\(|"
    r"unique\s*\(|unique\s+(?:key|index)\b|(?:key|index|fulltext|spatial)\s+[`\"\w]*\s*\()"
)
_KEY = r"(?isU)^(?:constraint\s+\S+\s+)?primary\s+key\s*\(\s*[`\"]?(\w+)[`\"]?\s*\)"
_KEYS = (
    r"(?isU)^(?:constraint(?:\s+[`\"]?\w+[`\"]?)?\s+)?(?:primary\s+key|unique(?:\s+(?:key|index))?)"
    r"(?:\s+[`\"]?\w+[`\"]?)?(?:\s+using\s+\w+)?\s*\(((?:[^()]|\(\s*\d+\s*\))*)\)"
)
_PART_OF_KEY = r"(?iU)\(\s*\d+\s*\)|\s+(?:asc|desc)\b"
_COLUMN = r"(?isU)^(?:[`\"]([^`\"]+)[`\"]|(\S+))\s*(.*)$"
_INSERT = r"(?iU)^insert\s+into\s+" + _NAME + r"\s*(\([^()]*\))?\s*values\s*"
_TUPLE_OR_REST = _NESTED + r"|[^\s,(][^(]*+|\("
_FIELD = r"[xX]'[0-9a-fA-F]*+'|" + LITERAL + r"|[^'\",\s](?:[^'\",]*[^'\",\s])?"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# A tuple of numbers, NULLs and texts without a quote or comma in them; the text 'NULL' is left out.
_PLAIN = r"(?:[+-]?(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?|NULL|'(?!NULL')[^',\"]*+')"
_PLAIN_TUPLE = r"^\(" + _PLAIN + r"(?:, ?" + _PLAIN + r")*+\)\z"
_DEFAULT = r"(?isU)\bdefault\s+(" + LITERAL + r"|[+-]?[\d.]+|current_timestamp\b)"

# Column types of dumps and the Spark types they are read as.
INTEGERS = ("int", "integer", "bigint", "smallint", "mediumint", "tinyint")
NUMBERED = ("int", "integer", "bigint", "tinyint")
DECIMALS = ("decimal", "numeric")
DOUBLES = ("float", "double", "real")
MOST_DIGITS = 38  # of Spark's decimals; longer ones are read as texts

# Constants that are words, and how numbers and bytes are written in base 16.
WORDS = {"TRUE": "1", "FALSE": "0"}
NOW = "CURRENT_TIMESTAMP"
_HEX = r"(?i)^0x[0-9a-f]+$"
_BYTES = r"(?i)^x'[0-9a-f]*'$"


MISSING = "missing value"
UNREAD = "unread text in statement"

# The place of a row in its dump.
PLACE = ["path", "stmt_no", "part_no", "row_no"]

TOGETHER = 16  # statements that make rows from rows, in one job
HELD = 2000  # of them, known to the driver at once

# Types of selected columns that are fitted to a table's before they are written.
PLAIN_TYPES = frozenset("string byte short integer long float double decimal boolean date timestamp".split())


def _names(text: Column) -> Column:
    """A column list in lower case, joined by commas alone."""
    return F.lower(F.regexp_replace(text, r"[()`\"\s]", ""))


def _is_quoted(field: Column) -> Column:
    return F.startswith(field, F.lit("'")) | F.startswith(field, F.lit('"'))


def _now() -> Column:
    """The time, in UTC, is that of loading."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def _value(field: Column) -> Column:
    """The text of a constant: unquoted, with NULL as null, truth as 1 or 0, numbers in
    base 10, bytes as the text they are in UTF-8."""
    quote = F.substring(field, F.lit(1), F.lit(1))
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    inner = F.replace(inner, F.concat(quote, quote), quote)
    upper = F.upper(field)
    found = F.when(_is_quoted(field), inner).when(upper == "NULL", F.lit(None))
    for word, text in WORDS.items():
        found = found.when(upper == word, text)
    return (
        found.when(upper == NOW, _now())
        .when(field.rlike(_HEX), F.conv(F.substring(field, F.lit(3), F.length(field)), 16, 10))
        .when(field.rlike(_BYTES), F.decode(F.unhex(F.substring(field, F.lit(3), F.length(field) - 3)), "UTF-8"))
        .otherwise(field)
    )


def _is_constant(field: Column) -> Column:
    return (
        _is_quoted(field) | F.upper(field).isin("NULL", NOW, *WORDS)
        | field.rlike(_NUMBER) | field.rlike(_HEX) | field.rlike(_BYTES)
    )


# -- Parentheses of any depth, for the declarations and the few tuples that have them ------

_MARKS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|([(),])")


def _list_items(text: str) -> list[str]:
    """A list cut at its commas, but for those in parentheses or quotes."""
    items, depth, begin = [], 0, 0
    for mark in _MARKS.finditer(text):
        if mark[1] == ",":
            if depth == 0:
                items.append(text[begin : mark.start()])
                begin = mark.end()
        elif mark[1]:
            depth += 1 if mark[1] == "(" else -1
    return [*items, text[begin:]]


def _declared_items(stmt: str) -> list[str]:
    """What a CREATE TABLE declares, between its outer parentheses."""
    depth, begin = 0, None
    for mark in _MARKS.finditer(stmt):
        if mark[1] == "(":
            depth += 1
            begin = mark.end() if begin is None else begin
        elif mark[1] == ")":
            depth -= 1
            if depth == 0:
                return _list_items(stmt[begin : mark.start()])
    return []


def _tuples(text: str) -> list[str]:
    """The tuples of a VALUES list, and what stands between them."""
    items, depth, begin = [], 0, 0

    def between(end: int) -> None:
        rest = text[begin:end].strip(" \t\r\n,")
        if rest:
            items.append(rest)

    for mark in _MARKS.finditer(text):
        if mark[1] == "(":
            if depth == 0:
                between(mark.start())
                begin = mark.start()
            depth += 1
        elif mark[1] == ")" and depth:
            depth -= 1
            if depth == 0:
                items.append(text[begin : mark.end()])
                begin = mark.end()
    if depth:  # not closed: no tuple, whatever it ends with
        items.append(text[begin:].rstrip(")") or "(")
    else:
        between(len(text))
    return items


def _in_python(split: Callable[[str], list[str]]):
    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run


_IDS = ["path", "stmt_no", "part_no"]


def _declared(statements: DataFrame) -> DataFrame:
    """(path, stmt_no, part_no, table_name, items): what each CREATE TABLE declares."""
    tables = statements.where(statement_kind(F.col("stmt")) == "create_table").select(
        *_IDS,
        F.lower(table_name(F.col("stmt"))).alias("table_name"),
        _in_python(_declared_items)(strip_comments(F.col("stmt"))).alias("declared"),
    )
    return tables.withColumn("items", F.transform("declared", strip))


def _columns_among(items: str) -> Column:
    return F.filter(items, lambda item: (item != "") & ~F.rlike(item, F.lit(_CONSTRAINT)))


def dump_columns(statements: DataFrame) -> DataFrame:
    """(path, stmt_no, part_no, table_name, col_no, col_name, spark_type, default, numbered, required).

    ``numbered`` marks an integer primary key: a row without one gets the next number.
    ``required`` marks the other columns that are NOT NULL.
    """
    keys = F.filter("items", lambda item: F.rlike(item, F.lit(_KEY)))
    columns = (
        _declared(statements)
        .withColumn("key", F.lower(F.regexp_extract(F.get(keys, F.lit(0)), _KEY, 1)))
        .select(*_IDS, "table_name", "key", F.posexplode_outer(_columns_among("items")).alias("col_no", "item"))
        .where(F.col("col_no").isNotNull())
    )
    rest = F.regexp_extract("item", _COLUMN, 3)
    bare = F.regexp_replace(rest, LITERAL, "''")
    kind = F.lower(F.regexp_extract(rest, r"^\w+", 0))
    size = F.regexp_extract(rest, r"^\w+\s*\(\s*(\d+\s*(?:,\s*\d+)?)\s*\)", 1)
    digits, places = F.split(size, ",")[0].try_cast("int"), F.coalesce(F.get(F.split(size, ","), F.lit(1)).try_cast("int"), F.lit(0))
    fits = (digits <= MOST_DIGITS) & (places <= digits)
    spark_type = (
        F.when(kind.isin(*INTEGERS), "bigint")
        .when(kind.isin(*DECIMALS) & (size != "") & ~F.coalesce(fits, F.lit(False)), "string")
        .when(kind.isin(*DECIMALS) & (size != ""), F.concat(F.lit("decimal("), size, F.lit(")")))
        .when(kind.isin(*DECIMALS), "decimal(38,10)")
        .when(kind.isin(*DOUBLES), "double")
        .otherwise("string")
    )
    name = _column_name()
    is_key = rest.rlike(r"(?i)\bprimary\s+key\b") | (F.lower(name) == F.col("key"))
    numbered = F.coalesce(kind.isin(*NUMBERED) & (size == "") & is_key, F.lit(False))
    return columns.select(
        *_IDS,
        "table_name",
        "col_no",
        name.alias("col_name"),
        F.regexp_replace(spark_type, r"\s+", "").alias("spark_type"),
        F.nullif(F.regexp_extract(rest, _DEFAULT, 1), F.lit("")).alias("default"),
        numbered.alias("numbered"),
        (bare.rlike(r"(?i)\bnot\s+null\b") & ~numbered).alias("required"),
    )


def _column_name() -> Column:
    return F.concat(F.regexp_extract("item", _COLUMN, 1), F.regexp_extract("item", _COLUMN, 2))


def dump_keys(statements: DataFrame) -> DataFrame:
    """(path, stmt_no, part_no, table_name, key_no, columns): PRIMARY KEY and UNIQUE, of a column
    or of the table, in the order they are declared. ``columns`` are in lower case."""
    items = _declared(statements).select(*_IDS, "table_name", F.posexplode_outer("items").alias("key_no", "item"))
    bare = F.regexp_replace(F.regexp_extract("item", _COLUMN, 3), LITERAL, "''")
    of_table = F.regexp_extract("item", _KEYS, 1)
    of_column = bare.rlike(r"(?i)\b(?:primary\s+key|unique)\b") & ~F.rlike("item", F.lit(_CONSTRAINT))
    found = F.when(of_table != "", F.split(_names(F.regexp_replace(of_table, _PART_OF_KEY, "")), ",")).when(
        of_column, F.array(F.lower(_column_name()))
    )
    return items.select(*_IDS, "table_name", "key_no", found.alias("columns")).where("columns IS NOT NULL")


class TableColumn(NamedTuple):
    name: str
    type: str
    default: str | None = None
    numbered: bool = False
    required: bool = False


def _default(constant: str | None) -> Column:
    """A default as the constant it is written as."""
    return F.lit(constant).cast("string")


def is_deep(stmt: Column) -> Column:
    """Whether parentheses are nested deeper than columns read them."""
    return stmt.rlike(_DEEPER)


def dump_rows(statements: DataFrame, deep: bool | None = None) -> DataFrame:
    """(path, stmt_no, part_no, table_name, names, row_no, fields, error, source).

    One row per tuple of each INSERT INTO. ``names`` is the column list if the
    statement has one, and ``fields`` the constants as written. What is no tuple
    becomes a row with an ``error``; ``source`` is the text of each row. ``deep`` says
    whether statements are all, or none, such as ``is_deep`` finds.
    """
    if deep is None:
        is_deep_one = is_deep(F.col("stmt"))
        shallow = dump_rows(statements.where(~is_deep_one), deep=False)
        return shallow.unionByName(dump_rows(statements.where(is_deep_one), deep=True))
    rows = _tuple_rows(statements, deep)
    is_tuple, inner = _is_tuple(), F.expr("substring(source, 2, length(source) - 2)")
    return rows.select(
        *_IDS,
        "table_name",
        "names",
        "row_no",
        F.when(is_tuple, F.regexp_extract_all(inner, F.lit(_FIELD), F.lit(0))).alias("fields"),
        F.when(~is_tuple, UNREAD).alias("error"),
        "source",
    )


def _is_tuple() -> Column:
    return F.startswith("source", F.lit("(")) & F.endswith("source", F.lit(")"))


def _read_rows(statements: DataFrame, deep: bool) -> DataFrame:
    """The same with ``texts``: what the constants of a plain tuple say, unquoted, NULL as null.

    Nearly all tuples are plain, and cut at their commas; only the others have ``fields``, whose constants
    are told apart one by one.
    """
    rows = _tuple_rows(statements, deep).withColumn("plain", F.rlike("source", F.lit(_PLAIN_TUPLE)))
    inner = F.expr("substring(source, 2, length(source) - 2)")
    bare = F.replace(F.replace(inner, F.lit(", "), F.lit(",")), F.lit("'"))
    is_tuple = _is_tuple()
    rows = rows.select(
        *_IDS,
        "table_name",
        "names",
        "row_no",
        F.when(F.col("plain"), F.split(bare, ",")).alias("texts"),
        F.when(~F.col("plain") & is_tuple, F.regexp_extract_all(inner, F.lit(_FIELD), F.lit(0))).alias("fields"),
        F.when(~is_tuple, UNREAD).alias("error"),
        "source",
    )
    nulls_in = F.transform("texts", lambda t: F.when(t != "NULL", t))
    return rows.withColumn("texts", F.when(F.contains("source", F.lit("NULL")), nulls_in).otherwise(F.col("texts")))


def _tuple_rows(statements: DataFrame, deep: bool) -> DataFrame:
    """(path, stmt_no, part_no, table_name, names, row_no, source) of ``dump_rows``."""
    ids = [*_IDS, "table_name"]
    stmt = F.col("stmt")
    has_comment = stmt.contains("--") | stmt.contains("/*") | stmt.contains("#")
    body = F.when(F.col("head") != "", F.expr("substring(stmt, length(head) + 1)"))
    items = _in_python(_tuples)(F.col("body")) if deep else F.regexp_extract_all("body", F.lit(_TUPLE_OR_REST), F.lit(0))
    return (
        statements.where(statement_kind(stmt) == "insert")
        .select(
            *_IDS,
            F.lower(table_name(stmt)).alias("table_name"),
            F.when(has_comment, strip_comments(stmt)).otherwise(stmt).alias("stmt"),
        )
        .withColumn("head", F.regexp_extract("stmt", _INSERT, 0))
        .withColumn("list", F.regexp_extract("head", _INSERT, 1))
        .withColumn("body", body)
        .withColumn("names", F.when(F.col("list") != "", _names(F.col("list"))))
        .withColumn("items", F.coalesce(items, F.array().cast("array<string>")))
        .withColumn("items", F.when(F.size("items") == 0, F.array("stmt")).otherwise(F.col("items")))
        # A plain explode would first filter on the array's size, and so build it twice.
        .select(*ids, "names", F.posexplode_outer("items").alias("row_no", "source"))
    )


def type_rows(rows: DataFrame, columns: list[TableColumn]) -> DataFrame:
    """The columns of one table, with the place of each row and the ``__error`` it has.

    Each row's constants are put in the order of the columns and unquoted as arrays;
    what is left per column is a cast, which keeps the generated code of wide tables
    small. ``rows`` may have ``texts``, constants that are known as such and unquoted.
    """
    declared = ",".join(c.name.lower() for c in columns)
    catalog = F.array(
        *[
            F.struct(F.lit(c.name.lower()).alias("name"), _default(c.default).alias("default"))
            for c in columns
        ]
    )
    if "texts" not in rows.columns:
        rows = rows.withColumn("texts", F.lit(None).cast("array<string>"))
    plain = F.col("texts").isNotNull()
    in_order = F.col("names").isNull() | (F.col("names") == declared)
    given = F.split("names", ",")

    def constant(column: Column) -> Column:
        place = F.array_position(given, column["name"]).cast("int")
        return F.when(place > 0, F.get("fields", place - 1)).otherwise(column["default"])

    def text(column: Column) -> Column:
        place = F.array_position(given, column["name"]).cast("int")
        return F.when(place > 0, F.get("texts", place - 1)).otherwise(_value(column["default"]))

    as_declared = F.when(F.col("names") == declared, len(declared.split(",")))
    expected = F.when(F.col("names").isNull(), len(columns)).otherwise(F.coalesce(as_declared, F.size(given)))
    unknown = F.size(F.array_except(given, F.split(F.lit(declared), ","))) > 0
    constants = F.forall("fields", _is_constant)
    early = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.when(plain, F.size("texts")).otherwise(F.size("fields")) != expected, "wrong number of values")
        .when(~in_order & unknown, "unknown column")
        .when(~plain & ~constants, "not a constant")
    )
    ordered = F.when(in_order, F.col("fields")).otherwise(F.transform(catalog, constant))
    texts = (
        F.when(plain & in_order, F.col("texts"))
        .when(plain, F.transform(catalog, text))
        .otherwise(F.transform(ordered, _value))
    )
    rows = rows.withColumn("_early", early).withColumn("_texts", F.when(F.col("_early").isNull(), texts))
    cast = {
        f"_cast_{i}": F.get("_texts", F.lit(i)).try_cast(c.type) for i, c in enumerate(columns)
    }
    rows = rows.withColumns(cast)
    # A cast that fails gives one null more than the row was written with.
    nulls = sum((F.col(name).isNull().cast("int") for name in cast), F.lit(0))
    written_nulls = F.size(F.filter("_texts", lambda t: t.isNull()))
    missing = reduce(or_, (F.col(name).isNull() for name, c in zip(cast, columns) if c.required), F.lit(False))
    error = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when((nulls > 0) & (nulls != written_nulls), "value does not fit its column")
        .when(missing, MISSING)
    )
    return rows.withColumn("__error", error).select(
        *[F.col(value).alias(c.name) for value, c in zip(cast, columns)],
        *[F.col(c).alias(f"__{c}") for c in PLACE],
        "__error",
        F.when(F.col("__error").isNotNull(), F.col("source")).alias("__source"),
    )


def number_rows(rows: DataFrame, key: str) -> DataFrame:
    """Fill in missing keys: each gets one more than the largest key before it.

    With c rows without a key up to a row, the largest key so far is c plus the
    largest of 0 and e - c over the keys e given so far. Both are running values: over
    ranges of rows in the dump's order first, each a task's share however the rows are
    spread over statements, and then over one pair of numbers per range, on the driver.
    """
    spark = rows.sparkSession
    place = ["__path", "__stmt_no", "__part_no", "__row_no"]
    ranged = rows.repartitionByRange(*place).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "numbering")
    so_far = W.partitionBy("__range").orderBy(*place).rowsBetween(W.unboundedPreceding, W.currentRow)
    good = F.col("__error").isNull()
    missing = (good & F.col(f"`{key}`").isNull()).cast("long")
    ranged = ranged.withColumn("__c", F.sum(missing).over(so_far))
    given = F.when(good, F.col(f"`{key}`") - F.col("__c"))
    ranged = ranged.withColumn("__top", F.max(given).over(so_far))

    ends = ranged.groupBy("__range").agg(F.max("__c").alias("n"), F.max("__top").alias("top"))
    carried, before, top_before = [], 0, 0
    for end in ends.orderBy("__range").collect():
        carried.append((end["__range"], before, top_before))
        top_before = max(top_before, 0 if end["top"] is None else end["top"] - before)
        before += end["n"]
    carried = spark.createDataFrame(carried, "__range int, before long, top_before long")

    ranged = ranged.join(F.broadcast(carried), "__range")  # a row per task
    top = F.greatest(F.lit(0), F.col("__top") - F.col("before"), F.col("top_before"))
    number = F.when(good, F.col("__c") + F.col("before") + top)
    return ranged.withColumn(key, F.coalesce(f"`{key}`", number)).drop(
        "__range", "__c", "__top", "before", "top_before"
    )


@dataclass
class LoadedDump:
    """Tables by their lower-case name, what none of them could take, and the statements
    that declare them."""

    tables: dict[str, DataFrame]
    rejects: DataFrame
    declarations: DataFrame

    def register(self) -> list[str]:
        """Make the tables known to SQL in this session."""
        for name, table in self.tables.items():
            table.createOrReplaceTempView(name)
        return sorted(self.tables)

    def save(self, database: str) -> None:
        """Keep the tables in a database, for queries that name it or run in it."""
        for name, table in self.tables.items():
            table.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
            table.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")


def _first_declarations(statements: DataFrame) -> DataFrame:
    """Of two declarations of a table the first counts."""
    named = statements.where(statement_kind(F.col("stmt")) == "create_table").groupBy(
        F.lower(table_name(F.col("stmt"))).alias("table_name")
    )
    return named.agg(F.min(F.struct("path", "stmt_no", "part_no", "stmt")).alias("first")).select("first.*")


def declared_tables(statements: DataFrame) -> dict[str, list[TableColumn]]:
    """The columns of each table of one database."""
    columns = dump_columns(_first_declarations(statements)).orderBy("table_name", "col_no")
    tables: dict[str, list[TableColumn]] = {}
    for c in columns.toLocalIterator():
        column = TableColumn(c["col_name"], c["spark_type"], c["default"], c["numbered"], c["required"])
        tables.setdefault(c["table_name"], []).append(column)
    return tables


def declared_keys(statements: DataFrame) -> dict[str, list[tuple[str, ...]]]:
    """The keys of each table of one database, each once."""
    found = dump_keys(_first_declarations(statements)).orderBy("table_name", "key_no")
    tables: dict[str, list[tuple[str, ...]]] = {}
    for k in found.toLocalIterator():
        keys = tables.setdefault(k["table_name"], [])
        if tuple(k["columns"]) not in keys:
            keys.append(tuple(k["columns"]))
    return tables


class _Loading:
    """The tables of a dump while they are loaded: typed rows, and what constraints leave of them."""

    def __init__(self, spark: SparkSession, folder: str, apart: DataFrame, pool: ThreadPoolExecutor) -> None:
        self.spark, self.folder, self.apart, self.pool = spark, folder, apart, pool
        self.session = spark.newSession()  # of the derived statements
        creates = apart.where(F.col("kind") == "create_table")
        self.columns = declared_tables(creates)
        self.keys = {
            name: [k for k in keys if set(k) <= {c.name.lower() for c in self.columns[name]}]
            for name, keys in declared_keys(creates).items()
            if name in self.columns
        }
        self.any_deep = not apart.where(F.col("kind") == "deep_insert").isEmpty()
        self.typed: dict[str, DataFrame] = {}
        self.done: dict[str, DataFrame] = {}
        self.visible: dict[str, DataFrame] = {}
        self.broken: dict[str, str] = {}
        self.failures: list[tuple] = []
        self.begun: dict[str, Row] = {}

    def rows_of(self, chosen: Column) -> DataFrame:
        apart = self.apart
        shallow = _read_rows(apart.where((F.col("kind") == "insert") & chosen).drop("kind", "for_table"), deep=False)
        if not self.any_deep:
            return shallow
        deep = apart.where((F.col("kind") == "deep_insert") & chosen).drop("kind", "for_table")
        return shallow.unionByName(_read_rows(deep, deep=True))

    def read(self, name: str) -> None:
        """The table's VALUES, typed."""
        try:
            rows = self.rows_of(F.col("for_table") == name)
            self.typed[name] = written(type_rows(rows, self.columns[name]), name, f"{self.folder}/tables/{name}")
        except PySparkException as problem:
            self.broken[name] = str(problem)

    def accepted(self, name: str) -> DataFrame:
        """The table's rows so far: numbered, and with an error where they repeat a key."""
        if name not in self.done:
            table = self.typed[name]
            for c in self.columns[name]:
                lacking = F.col("__error").isNull() & F.col(f"`{c.name}`").isNull()
                if c.numbered and not table.where(lacking).isEmpty():
                    table = written(number_rows(table, c.name), name, new_folder(self.spark, f"numbered-{name}"))
            self.done[name] = without_repeats(table, self.keys.get(name, []), name, new_folder(self.spark, f"keyed-{name}"))
        return self.done[name]

    def finish(self, name: str) -> None:
        try:
            self.accepted(name)
        except PySparkException as problem:
            self.broken[name] = str(problem)

    def seen(self, name: str) -> DataFrame:
        """The rows that no constraint has refused, with their statements, in the session of the derived ones."""
        if name not in self.visible:
            rows = self.accepted(name).where(F.col("__error").isNull()).drop("__row_no", "__error", "__source")
            folder = new_folder(self.spark, "seen-by-statements")
            written(rows, name, folder)
            self.visible[name] = self.session.read.schema(rows.schema).parquet(folder)
        return self.visible[name]

    def put(self, name: str, rows: DataFrame) -> None:
        self.typed[name] = rows
        self.done.pop(name, None)
        self.visible.pop(name, None)

    def fail(self, statement: Row, problem: PySparkException) -> tuple:
        place = (statement["path"], statement["stmt_no"], statement["part_no"])
        return (statement["table_name"], *place, 0, str(problem)[:500], statement["stmt"])

    def derive(self, statements: Iterable[Row]) -> None:
        """Run INSERT .. SELECT and CREATE TABLE .. AS SELECT; a failure is noted and stops nothing."""
        waiting: list[Row] = []
        for statement in statements:
            name = statement["table_name"]
            if statement["kind"] == CREATE_AS and name not in self.columns:
                self.insert(waiting)
                waiting = []
                self.create(statement)
            elif statement["kind"] == CREATE_AS:
                if not statement["spares"]:
                    self.failures.append(self.fail(statement, PySparkException(message=f"table {name} exists.")))
            elif name not in self.typed:
                self.failures.append(self.fail(statement, PySparkException(message=f"no such table: {name}.")))
            else:
                waiting.append(statement)
            if len(waiting) == HELD:
                self.insert(waiting)
                waiting = []
        self.insert(waiting)

    def named(self, statement: Row) -> set[str]:
        """The tables that a statement's query reads; none if it is no query, which it fails by when it runs."""
        try:
            return relations(self.spark, statement["sql"]) & set(self.typed)
        except PySparkException:
            return set()

    def selected(self, statement: Row, names: set[str]) -> DataFrame:
        return selected_rows(self.session, statement, names, self.seen)

    def create(self, statement: Row) -> None:
        name = statement["table_name"]
        try:
            placed, folder = self.selected(statement, self.named(statement)), new_folder(self.spark, "derived-rows")
            written(placed, name, folder)
            rows = self.spark.read.schema(placed.schema).parquet(folder)
            self.columns[name] = [
                TableColumn(f.name, f.dataType.simpleString()) for f in rows.schema if not f.name.startswith("__")
            ]
            self.begun[name] = statement
            later = type_rows(self.rows_of(F.col("for_table") == name), self.columns[name]).where(~before(statement))
            self.put(name, _fitted(rows, self.columns[name], None).unionByName(later))
        except PySparkException as problem:
            self.failures.append(self.fail(statement, problem))

    def insert(self, statements: list[Row]) -> None:
        """Run INSERTs, which read and write tables that are all there, as if one after the other."""
        free, bound, changing = [], [], set()
        for statement, names in zip(statements, self.pool.map(self.named, statements)):
            (bound if names & changing else free).append((statement, names))
            changing.add(statement["table_name"])
        made, failures = self.run(free)
        self.failures += failures
        for name, rows in made:
            self.put(name, self.typed[name].unionByName(rows))
        size = TOGETHER
        while bound:
            settled = self.settle(bound[:size])
            bound, size = bound[settled:], 2 * settled

    def settle(self, window: list[tuple[Row, set[str]]]) -> int:
        """Run statements on what is there now; the number of them, from the first, that saw what they had to see."""
        reads, begin = set().union(*[names for _, names in window]), window[0][0]
        made, failures = self.run(window)
        changed = {name for name, _ in made} | {statement["table_name"] for statement, _ in window}
        old_typed = {name: self.typed[name] for name in changed}
        old_seen = {name: self.visible[name] for name in changed & reads if name in self.visible}
        for name, rows in made:
            self.put(name, self.typed[name].unionByName(rows))
        settled = window
        if len(window) > 1:
            try:
                spots = [first_change(old, self.seen(name), begin) for name, old in old_seen.items()]
                end = min((spot for spot in spots if spot is not None), default=None)
            except PySparkException:  # such as rows that cannot be numbered: one by one, it is those that read them which fail
                end = (begin["path"], begin["stmt_no"], begin["part_no"])
            if end is not None:
                settled = [x for x in window if (x[0]["path"], x[0]["stmt_no"], x[0]["part_no"]) <= end] or window[:1]
        if len(settled) < len(window):
            after = window[len(settled)][0]
            for name, rows in old_typed.items():
                self.put(name, rows)
            for name, rows in made:
                self.put(name, self.typed[name].unionByName(rows.where(before(after))))
        known = {(x[0]["path"], x[0]["stmt_no"], x[0]["part_no"]) for x in settled}
        self.failures += [failure for failure in failures if failure[1:4] in known]
        return len(settled)

    def run(self, some: list[tuple[Row, set[str]]]) -> tuple[list[tuple[str, DataFrame]], list[tuple]]:
        """What INSERTs add to their tables, and what has failed; many of them make one job."""
        ready: dict[str, list[tuple[Row, DataFrame]]] = {}
        made, failures, jobs = [], [], []
        for statement, names in some:
            name = statement["table_name"]
            try:
                rows = self.selected(statement, names)
                if any(f.dataType.typeName() not in PLAIN_TYPES for f in rows.schema):
                    folder = new_folder(self.spark, "derived-rows")
                    written(rows, name, folder)
                    rows = self.session.read.schema(rows.schema).parquet(folder)
                _check_fit(_own(rows), self.columns[name], _given(statement))
                ready.setdefault(name, []).append((statement, rows))
            except PySparkException as problem:
                failures.append(self.fail(statement, problem))
            if len(ready.get(name, [])) == TOGETHER:
                jobs.append(self.pool.submit(self.run_together, name, ready.pop(name)))
        jobs += [self.pool.submit(self.run_together, name, chunk) for name, chunk in ready.items()]
        for job in jobs:
            more, failed = job.result()
            made += more
            failures += failed
        return made, failures

    def fitted(self, name: str, chunk: list[tuple[Row, DataFrame]]) -> DataFrame:
        """The rows of some queries as those of their table; those of the same types are made so together."""
        alike: dict[tuple, list[DataFrame]] = {}
        for statement, rows in chunk:
            own, schema = _own(rows), rows.schema
            types = tuple(f.dataType.simpleString() for f in schema if not f.name.startswith("__"))
            plain = rows.columns == [*own, *[f"__{c}" for c in PLACE]] and all(c.isprintable() for c in own)
            key = (statement["list"], types, None if plain else tuple(own), len(schema))
            if plain:
                rows = rows.toDF(*[f"c{i}" for i in range(len(own))], *rows.columns[len(own) :])
                rows = rows.withColumn("__names", F.lit([f"{json.dumps(c, ensure_ascii=False)}:" for c in own]))
            alike.setdefault(key, []).append(rows)
        together = [
            _fitted(reduce(DataFrame.union, some), self.columns[name], key[0].split(",") if key[0] else None)
            for key, some in alike.items()
        ]
        return reduce(DataFrame.unionByName, together)

    def run_together(self, name: str, chunk: list[tuple[Row, DataFrame]]) -> tuple[list[tuple[str, DataFrame]], list[tuple]]:
        """One job for some queries, or one for each if that fails, to know by which."""
        folder = new_folder(self.spark, f"derived-{name}")
        try:
            rows = self.fitted(name, chunk)
            written(rows, name, folder)
            return [(name, self.spark.read.schema(rows.schema).parquet(folder))], []
        except PySparkException as problem:
            if len(chunk) == 1:
                return [], [self.fail(chunk[0][0], problem)]
        made, failures = [], []
        for one in chunk:
            more, failed = self.run_together(name, [one])
            made += more
            failures += failed
        return made, failures


def _own(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if not c.startswith("__")]


def _given(statement: Row) -> list[str] | None:
    return statement["list"].split(",") if statement["list"] else None


def _check_fit(own: list[str], columns: list[TableColumn], given: list[str] | None) -> list[str]:
    """The columns that selected ones go to."""
    names = given or [c.name.lower() for c in columns]
    if len(names) != len(own):
        raise PySparkException(message=f"{len(own)} values for {len(names)} columns.")
    if unknown := set(names) - {c.name.lower() for c in columns}:
        raise PySparkException(message=f"unknown column {sorted(unknown)[0]}.")
    return names


def _as_json(rows: DataFrame, own: list[str]) -> Column:
    """A row as JSON; ``__names``, if there, has the names of its columns as they stand there."""
    if "__names" not in rows.columns:
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"})
    parts = []
    for i, c in enumerate(own):
        value = F.to_json(F.struct(F.col(c).alias("c")), {"ignoreNullFields": "false"})  # {"c":..}
        parts.append(F.concat(F.get("__names", F.lit(i)), F.substring(value, F.lit(6), F.length(value) - 6)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _fitted(rows: DataFrame, columns: list[TableColumn], given: list[str] | None) -> DataFrame:
    """Selected rows as those of a table: columns by their order or as ``given``, defaults, errors."""
    own = _own(rows)
    source = dict(zip(_check_fit(own, columns, given), own))
    values, misfit, missing = [], F.lit(False), F.lit(False)
    for c in columns:
        if c.name.lower() in source:
            text = F.col(f"`{source[c.name.lower()]}`")
            value = text.cast("string").try_cast(c.type) if c.type == "bigint" or c.type.startswith("decimal") else text.try_cast(c.type)
            misfit = misfit | (text.isNotNull() & value.isNull())
        else:
            value = _value(_default(c.default)).try_cast(c.type)
        missing = missing | value.isNull() if c.required else missing
        values.append(value.alias(c.name))
    error = F.when(misfit, "value does not fit its column").when(missing, MISSING)
    as_text = _as_json(rows, own)
    return rows.select(
        *values,
        *[F.col(f"__{c}") for c in PLACE],
        error.alias("__error"),
        F.when(error.isNotNull(), as_text).alias("__source"),
    )


def load_dump(statements: DataFrame, folder: str | None = None, concurrency: int = 4) -> LoadedDump:
    """The tables of one database, written below ``folder`` as Parquet.

    The statements are first written apart by kind and table, so that each table's
    job reads its own; it parses and casts them in one pass and without a shuffle. Rows without a
    value that is NOT NULL, and those that repeat a PRIMARY KEY or UNIQUE value of a row before
    them, are refused. INSERT .. SELECT and CREATE TABLE .. AS SELECT run as if in the dump's order
    over what the statements before them have loaded; see ``derived``.
    Only the table declarations and these statements reach the driver. A table that cannot be loaded
    stops no other: its rows are among ``rejects``, with the reason, as are all that are refused.
    """
    spark = statements.sparkSession
    folder = folder or new_folder(spark, "dump-tables")
    stmt, kind = F.col("stmt"), statement_kind(F.col("stmt"))
    told = (
        F.when((kind == "insert") & is_insert_select(stmt), INSERT_SELECT)
        .when((kind == "create_table") & is_create_as(stmt), CREATE_AS)
        .when((kind == "insert") & is_deep(stmt), "deep_insert")
        .otherwise(kind)
    )
    # A filter on what has been told would tell it twice.
    kept = statements.where(kind != "other").select("*", told.alias("kind"), F.lower(table_name(stmt)).alias("for_table"))
    kept.write.mode("overwrite").partitionBy("kind", "for_table").parquet(f"{folder}/statements")
    apart = spark.read.schema(kept.schema).parquet(f"{folder}/statements")
    with ThreadPoolExecutor(concurrency) as pool:
        loading = _Loading(spark, folder, apart, pool)
        list(pool.map(loading.read, list(loading.columns)))
        loading.derive(derived_statements(apart).toLocalIterator())
        list(pool.map(loading.finish, list(loading.typed)))

    known = spark.createDataFrame([(name,) for name in loading.columns], "known string")
    strangers = apart.where(F.col("kind").isin("insert", "deep_insert")).join(
        F.broadcast(known), F.col("for_table").eqNullSafe(F.col("known")), "left_anti"
    )  # a row per declared table

    def all_rejected(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select("table_name", *PLACE, F.lit(reason).alias("error"), "source")

    no_table = "no such table"
    rejects = all_rejected(dump_rows(strangers.drop("kind", "for_table"), deep=None if loading.any_deep else False), no_table)
    for name, begun in loading.begun.items():
        early = loading.rows_of(F.col("for_table") == name)
        rejects = rejects.unionByName(all_rejected(early.where(before(begun, "")), no_table))
    for name, problem in loading.broken.items():
        reason = f"table could not be loaded: {problem[:200]}"
        rejects = rejects.unionByName(all_rejected(loading.rows_of(F.col("for_table") == name), reason))
    if loading.failures:
        rejects = rejects.unionByName(spark.createDataFrame(loading.failures, rejects.schema))
    own = [f"__{c}" for c in (*PLACE, "error", "source")]
    tables = {}
    for name, result in loading.done.items():
        if name in loading.broken:
            continue
        tables[name] = result.where(F.col("__error").isNull()).drop(*own)
        wrong = result.where(F.col("__error").isNotNull())
        rejects = rejects.unionByName(
            wrong.select(F.lit(name).alias("table_name"), *[F.col(c).alias(c[2:]) for c in own])
        )
    creates = apart.where(F.col("kind").isin("create_table", CREATE_AS)).drop("kind", "for_table")
    return LoadedDump(tables, rejects, creates)
