"""Parsing of model replies and review verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITESPACE, strip

# Marks looked for in replies and texts written into results.
FENCE = "```"
JSON_FENCE = "```json"
SQL_FENCE = "```sql"
DEFAULT_SUMMARY = "SQL query generated successfully"
FALLBACK_SUMMARY = "SQL extracted from response"
GENERATION_FAILED = "SQL generation failed: "
NO_SQL_FOUND = "Could not extract SQL from response: "
NO_SQL_FOUND_CHARS = 200
VALID = "VALID"
INVALID = "INVALID"
FIXED_MARK = "FIXED:"

_LINE_BLANKS = "".join(ch for ch in WHITESPACE if ch != "\n")
_COMMENT_LINE = r"(?md)^[" + _LINE_BLANKS + r"]*+--[^\n]*+\n?"


def _part(c: Column, mark: str, n: int) -> Column:
    return F.split_part(c, F.lit(mark), F.lit(n))


def json_payload(reply: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` of the fenced part, else null."""
    text = strip(reply)
    text = (
        F.when(F.contains(text, F.lit(JSON_FENCE)), _part(_part(text, JSON_FENCE, 2), FENCE, 1))
        .when(F.startswith(text, F.lit(FENCE)), _part(text, FENCE, 2))
        .otherwise(text)
    )
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inside = (first > 0) & F.contains(text, F.lit("}")) & (last >= first)
    return F.when(inside, F.substring(text, first, last - first + 1))


def extract_payloads(df: DataFrame, reply: str = "reply", out: str = "payload") -> DataFrame:
    """Add the reply's JSON object as struct<sql_query, summary>, null where it has none.

    JSON readers stop at the end of the first value, so text after it would slip
    through. The payload is read twice, once as the value of a key and once as the
    only element of an array: what may follow the value of a key cannot follow an
    element, so both succeed only if nothing follows the object.

    Each step is a column of its own, since expressions that are used several times
    would otherwise be evaluated several times.
    """
    options = {"allowSingleQuotes": "false"}
    fields = "struct<sql_query:string,summary:string>"
    value = F.from_json(
        F.concat(F.lit('{"v":'), "_payload", F.lit("}")),
        f"struct<v:{fields},_corrupt_record:string>",
        options,
    )
    element = F.from_json(
        F.concat(F.lit("["), "_payload", F.lit("]")), "array<struct<sql_query:string>>", options
    )
    return (
        df.withColumn("_payload", json_payload(F.col(reply)))
        .withColumn("_value", F.when(F.col("_payload").isNotNull(), value))
        .withColumn(
            "_alone",
            F.when(
                F.col("_value._corrupt_record").isNull() & F.col("_value.v").isNotNull(),
                F.size(element) == 1,
            ),
        )
        .withColumn(out, F.when(F.col("_alone"), F.col("_value.v")))
        .drop("_payload", "_value", "_alone")
    )


def clean_sql_reply(reply: Column) -> Column:
    """SQL text from a reply that holds no usable JSON."""
    text = (
        F.when(
            F.contains(reply, F.lit(SQL_FENCE)),
            strip(_part(_part(reply, SQL_FENCE, 2), FENCE, 1)),
        )
        .when(F.contains(reply, F.lit(FENCE)), strip(_part(reply, FENCE, 2)))
        .otherwise(reply)
    )
    text = strip(F.replace(text, F.lit("`"), F.lit("")))
    text = F.when(F.contains(text, F.lit("--")), F.regexp_replace(text, _COMMENT_LINE, "")).otherwise(text)
    return strip(F.substring_index(text, "/*", 1))


def parse_replies(df: DataFrame, reply: str = "reply", out: str = "parsed") -> DataFrame:
    """Add struct<predicted_sql, summary, status, error> for each generation reply."""
    failure = F.concat(
        F.lit(GENERATION_FAILED + NO_SQL_FOUND), F.substring("_reply", 1, NO_SQL_FOUND_CHARS)
    )
    no_sql = F.col("_sql") == ""
    parsed = F.struct(
        F.col("_sql").alias("predicted_sql"),
        F.when(no_sql, F.lit(""))
        .when(F.col("_from_json"), strip(F.coalesce("_object.summary", F.lit(DEFAULT_SUMMARY))))
        .otherwise(F.lit(FALLBACK_SUMMARY))
        .alias("summary"),
        F.when(no_sql, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.when(no_sql, failure).otherwise(F.lit("")).alias("error"),
    )
    df = extract_payloads(df.withColumn("_reply", strip(F.col(reply))), "_reply", "_object")
    return (
        df.withColumn("_json_sql", strip(F.col("_object.sql_query")))
        .withColumn("_from_json", F.coalesce(F.col("_json_sql") != "", F.lit(False)))
        .withColumn(
            "_sql",
            F.when(F.col("_from_json"), F.col("_json_sql")).otherwise(clean_sql_reply(F.col("_reply"))),
        )
        .withColumn(out, parsed)
        .drop("_reply", "_object", "_json_sql", "_from_json", "_sql")
    )


def parse_verdict(reply: Column) -> Column:
    """``VALID``, ``FIXED: <sql>`` or whatever else the reviewer said; blank is ``INVALID``."""
    text = strip(F.coalesce(reply, F.lit("")))
    fenced = F.contains(text, F.lit(FENCE))
    return (
        F.when(text == "", F.lit(INVALID))
        .when(fenced, strip(_part(text, FENCE, 2)))
        .otherwise(text)
    )


def fixed_sql(verdict: Column) -> Column:
    """The SQL of a ``FIXED:`` verdict, else null."""
    sql = strip(F.replace(verdict, F.lit(FIXED_MARK), F.lit("")))
    return F.when(F.startswith(verdict, F.lit(FIXED_MARK)), sql)


def review_fold(sql: Column, verdicts: Column, rounds: int = 3) -> Column:
    """Replay a review: struct<sql, reviewed, rounds> after at most ``rounds`` verdicts."""
    start = F.struct(
        sql.alias("sql"), F.lit(False).alias("reviewed"), F.lit(0).alias("rounds")
    )

    def step(acc: Column, verdict: Column) -> Column:
        after = F.struct(
            F.coalesce(fixed_sql(verdict), acc["sql"]).alias("sql"),
            (verdict == VALID).alias("reviewed"),
            (acc["rounds"] + 1).alias("rounds"),
        )
        return F.when(acc["reviewed"], acc).otherwise(after)

    return F.aggregate(F.slice(verdicts, 1, rounds), start, step)
