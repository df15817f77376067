"""Reply parsing, against plain Python on hand-written and generated replies."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from askloom.functions.replies import (
    clean_sql_reply,
    extract_payloads,
    parse_replies,
    parse_verdict,
    review_fold,
)

F3 = "```"

REPLIES = [
    '{"sql_query": "SELECT 1", "summary": "one"}',
    '  \n{"sql_query": "  SELECT 1 ", "summary": " one "} ',
    f'{F3}json\n{{"sql_query": "SELECT 1", "summary": "one"}}\n{F3}',
    f'Here:\n{F3}json\n{{"sql_query": "SELECT 1"}}\n{F3} and {F3}json\n{{"sql_query": "SELECT 2"}}{F3}',
    f'{F3}\n{{"sql_query": "SELECT 1", "summary": "one"}}\n{F3}',
    f'text {F3}\n{{"sql_query": "SELECT 1", "summary": "one"}}\n{F3}',
    'result={"sql_query": "SELECT 1", "summary": "one"}',
    '[{"sql_query": "SELECT 1"}]',
    '[{"sql_query": "SELECT 1"}, {"sql_query": "SELECT 2"}]',
    f"{F3}sql\nSELECT 1\n{F3}",
    f"text\n{F3}sql\nSELECT `a` FROM t -- end\n  -- whole line\nWHERE b /* c */ = 1\n{F3} more",
    f"text {F3}SELECT 1{F3} {F3}sql\nSELECT 2{F3}",
    f"{F3}\nSELECT 1\n{F3}",
    "SELECT a\n-- no\n\n   -- no\nFROM t\n--no",
    "-- only\n-- comments",
    "/* only a comment */",
    "SELECT a -- kept\nFROM t",
    "SELECT '--' || a\r\n\t-- x\r\nFROM t",
    '{"summary": "no sql"}',
    '{"sql_query": "", "summary": "empty"}',
    '{"sql_query": "   "}',
    "",
    "   \n",
    "{broken",
    '{"sql_query": "SELECT 1",}',
    "{'sql_query': 'SELECT 1'}",
    '{"sql_query": "SELECT\n1"}',
    '{"sql_query": "SELECT\\n1", "summary": "tab\\t\\u00e9"}',
    '{"sql_query": "a"} x {"sql_query": "b"}',
    '{"sql_query": "a"},{"sql_query": "b"}',
    '{"sql_query": "a"}],[{"sql_query": "b"}',
    '{"sql_query": "a"}} {"v": {"sql_query": "b"}',
    '{"sql_query": "a"},"w": {"sql_query": "b"}',
    '{"sql_query": "a", "sql_query": "b"}',
    '{"sql_query": "a", "x": NaN, "y": [1, {"z": null}]}',
    '{"sql_query": 5, "summary": 7}',
    '} {"sql_query": "a"',
    '}{',
    'nothing here } at { all',
    '"a string"',
    "123",
    "{}",
    "[]",
    '{"a": {"sql_query": "inner"}}',
    "`SELECT` `1`",
    f"{F3}{F3}",
    f"{F3}json{F3}",
    "é" * 250 + " /* x",
    "/*" + "é" * 250,
]


def py_payload(text):
    text = text.strip()
    if "```json" in text:
        text = text.partition("```json")[2].partition("```")[0].strip()
    elif text[:3] == F3:
        text = text[3:].partition("```")[0].strip()
    lo, hi = text.find("{"), text.rfind("}")
    if 0 <= lo <= hi:
        text = text[lo : hi + 1]
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def py_clean(text):
    for mark in ("```sql", "```"):
        if mark in text:
            text = text.split(mark)[1].split("```")[0].strip()
            break
    kept = [x for x in text.replace("`", "").strip().split("\n") if x.strip()[:2] != "--"]
    return "\n".join(kept).partition("/*")[0].strip()


def py_parse(reply):
    text = reply.strip()
    value = py_payload(text) or {}
    sql = value.get("sql_query")
    sql = "" if sql is None else str(sql).strip()
    if sql:
        summary = value.get("summary")
        summary = "SQL query generated successfully" if summary is None else str(summary)
        return sql, summary.strip(), "ok", ""
    sql = py_clean(text)
    if sql:
        return sql, "SQL extracted from response", "ok", ""
    return "", "", "error", (
        "SQL generation failed: Could not extract SQL from response: " + text[:200]
    )


@pytest.fixture(scope="module")
def replies(spark):
    pieces = [F3, "```json", "```sql", '{"sql_query": "x"}', "{", "}", "-- c", "/*", "\n", " a "]
    made = ["".join(p) for p in itertools.product(pieces, repeat=3)]
    texts = list(dict.fromkeys(REPLIES + made))
    return spark.createDataFrame([(t,) for t in texts], "reply string").repartition(8)


def test_payload(replies):
    got = extract_payloads(replies, out="p").collect()
    for row in got:
        want = py_payload(row["reply"])
        assert (row["p"] is None) == (want is None), row["reply"]
        if want is not None and isinstance(want.get("sql_query"), (str, type(None))):
            assert row["p"]["sql_query"] == want.get("sql_query"), row["reply"]


def test_clean_sql(replies):
    for row in replies.select("reply", clean_sql_reply(F.col("reply")).alias("sql")).collect():
        assert row["sql"] == py_clean(row["reply"]), repr(row["reply"])


def test_parse_reply(replies):
    for row in parse_replies(replies, out="p").collect():
        assert tuple(row["p"]) == py_parse(row["reply"]), repr(row["reply"])


def test_null_fields_count_as_missing(spark):
    df = spark.createDataFrame(
        [('{"sql_query": null}',), ('{"sql_query": "a", "summary": null}',)], "r string"
    )
    first, second = parse_replies(df, "r", "p").collect()
    assert first["p"]["predicted_sql"] == '{"sql_query": null}'
    assert second["p"]["summary"] == "SQL query generated successfully"


VERDICTS = {
    "VALID": "VALID",
    "  VALID \n": "VALID",
    "": "INVALID",
    " \n": "INVALID",
    None: "INVALID",
    "FIXED: SELECT 1": "FIXED: SELECT 1",
    f"{F3}\nVALID\n{F3}": "VALID",
    f"{F3}sql\nFIXED: SELECT 1\n{F3}": "sql\nFIXED: SELECT 1",
    f"Well: {F3}FIXED: SELECT 1{F3} x": "FIXED: SELECT 1",
    "valid": "valid",
    F3: "",
}


def test_verdicts(spark):
    df = spark.createDataFrame([(k, v) for k, v in VERDICTS.items()], "reply string, want string")
    for row in df.select("*", parse_verdict(F.col("reply")).alias("got")).collect():
        assert row["got"] == row["want"], row["reply"]


def py_review(sql, verdicts):
    for n, verdict in enumerate(verdicts[:3], 1):
        if verdict == "VALID":
            return sql, True, n
        if verdict[:6] == "FIXED:":
            sql = verdict.replace("FIXED:", "").strip()
    return sql, False, min(3, len(verdicts))


def test_review_fold(spark):
    choices = ["VALID", "FIXED: a", "FIXED: b FIXED: c", "INVALID", "sql FIXED: d", "FIXED:"]
    cases = [list(c) for n in range(5) for c in itertools.product(choices, repeat=n)]
    df = spark.createDataFrame([("q", c) for c in cases], "sql string, v array<string>")
    got = df.select("v", review_fold(F.col("sql"), F.col("v")).alias("r")).collect()
    for row in got:
        assert tuple(row["r"]) == py_review("q", row["v"]), row["v"]
