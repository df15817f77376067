"""The expected results, written for the check's SQL engine from the source columns.

Nothing here repeats a parsing step: each text is built as it should come out.
"""

from __future__ import annotations

from askloom.functions.prompts import GENERATION_PROMPT, REVIEW_PROMPT

from .sql import SQL, check_sql


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(template: str, **values: str) -> str:
    """The template as a SQL concatenation."""
    parts = [template]
    for name, sql in values.items():
        slot = "{%s}" % name
        parts = [
            piece
            for part in parts
            for piece in (
                [part] if isinstance(part, tuple) or slot not in part
                else [part.split(slot, 1)[0], (sql,), part.split(slot, 1)[1]]
            )
        ]
    return " || ".join(p[0] if isinstance(p, tuple) else _text(p) for p in parts if p)


def _strip(sql: str) -> str:
    return rf"regexp_replace({sql}, '^\s+|\s+$', '', 'g')"


# -- DDL ------------------------------------------------------------------------------

NORMALIZED = """
  SELECT p_partkey, 'db' || (p_partkey // 4) AS db_id, CAST(p_partkey % 4 AS INTEGER) AS doc_no,
    (p_partkey // 4) % 10 = 5 AS is_view,
    CASE
      WHEN (p_partkey // 4) % 10 = 5 THEN 'CREATE VIEW part_' || p_partkey || ' AS SELECT 1;'
      WHEN p_partkey % 7 = 0 THEN 'CREATE TABLE part_' || p_partkey || ' ( id int(11) NOT NULL, label TEXT DEFAULT '''
        || p_name || ''', PRIMARY KEY (id)) =8192 ;'
      WHEN p_partkey % 7 = 1 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INTEGER PRIMARY KEY, brand TEXT NOT NULL, '
        || 'seen TEXT, made TEXT DEFAULT CURRENT_TIMESTAMP , stock INTEGER );'
      WHEN p_partkey % 7 = 2 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INT, size INTEGER(1), brand TEXT );'
      WHEN p_partkey % 7 = 3 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INT, owner INT, UNIQUE (owner), '
        || 'FOREIGN KEY (owner) REFERENCES part_' || p_size || ' (id) );'
      WHEN p_partkey % 7 = 4 THEN 'CREATE TABLE part_' || p_partkey || ' ( price DECIMAL(10,2) NOT NULL, note TEXT );'
      WHEN p_partkey % 7 = 5 THEN 'create table part_' || p_partkey || ' (id integer, ' || lower(p_type) || ' text);'
      ELSE 'CREATE TABLE part_' || p_partkey || ' (id INT , kind TEXT COMMENT ''' || p_type || ''');'
    END AS doc
  FROM part"""

CLEANED = """
  SELECT p_partkey,
    CASE
      WHEN (p_partkey // 4) % 10 = 5 THEN 'CREATE VIEW part_' || p_partkey || ' AS SELECT 1;'
      WHEN p_partkey % 7 = 0 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INTEGER(11) NOT NULL, label TEXT DEFAULT '''
        || p_name || ''', PRIMARY KEY (id)) =8192 ;'
      WHEN p_partkey % 7 = 1 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INTEGER PRIMARY KEY, brand TEXT NOT NULL, '
        || 'seen TEXT, made TEXT DEFAULT CURRENT_TIMESTAMP , stock INTEGER );'
      WHEN p_partkey % 7 = 2 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INTEGER, size INTEGER(1), brand TEXT );'
      WHEN p_partkey % 7 = 3 THEN 'CREATE TABLE part_' || p_partkey || ' ( id INTEGER, owner INTEGER, UNIQUE (owner), '
        || 'FOREIGN KEY (owner) REFERENCES part_' || p_size || ' (id) );'
      WHEN p_partkey % 7 = 4 THEN 'CREATE TABLE part_' || p_partkey || ' ( price REAL NOT NULL, note TEXT );'
      WHEN p_partkey % 7 = 5 THEN 'create table part_' || p_partkey || ' (id integer, ' || lower(p_type) || ' text);'
      ELSE 'CREATE TABLE part_' || p_partkey || ' (id INTEGER , kind TEXT );'
    END AS ddl
  FROM part"""

DOCS = f"SELECT db_id, doc_no, 'schema_doc_' || doc_no AS doc_id, doc FROM ({NORMALIZED}) d WHERE NOT is_view"
DATABASES = "SELECT DISTINCT 'db' || (p_partkey // 4) AS db_id FROM part"


def _schema_text(separator: str) -> str:
    return (
        f"SELECT db_id, string_agg(doc, {separator} ORDER BY doc_no) AS schema_text "
        f"FROM ({DOCS}) docs GROUP BY db_id"
    )


SCHEMA_TEXT = _schema_text("chr(10) || chr(10)")
REVIEW_TEXT = _schema_text("chr(10)")

# -- Dumps ----------------------------------------------------------------------------

CLIENTS = """
  SELECT c_custkey,
    CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN 'O''' || c_name WHEN 2 THEN c_name || ', (x)'
      WHEN 3 THEN c_name || ';' || chr(10) || '-- ' || c_mktsegment WHEN 4 THEN 'NULL' END AS c_name,
    CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
  FROM customer"""

_CLIENT_DDL = (
    "c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(60), c_nationkey INT, "
    "c_acctbal DOUBLE, c_mktsegment VARCHAR(20) NOT NULL, KEY k (c_name)"
)

CLIENT_STATEMENTS = f"""
  WITH tuples AS (
    SELECT c_custkey, '(' || c_custkey || ', ' || coalesce('''' || replace(c_name, '''', '''''') || '''', 'NULL')
      || ', ' || c_nationkey || ', ' || c_acctbal || ', ''' || c_mktsegment || ''')' AS t
    FROM ({CLIENTS}) c
  ), statements AS (
    SELECT c_custkey // 500 AS shard, 2 + c_custkey // 100 AS ord,
      1 + count(*) FILTER (c_custkey % 6 = 3) AS n_pieces, 'insert' AS kind,
      'INSERT INTO client (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES' || chr(10)
        || string_agg(t, ',' || chr(10) ORDER BY c_custkey) AS stmt
    FROM tuples GROUP BY 1, 2
    UNION ALL SELECT DISTINCT c_custkey // 500, 0, 1, 'other', 'DROP TABLE IF EXISTS client' FROM customer
    UNION ALL SELECT DISTINCT c_custkey // 500, 1, 1, 'create_table', {_text("CREATE TABLE client (" + _CLIENT_DDL + ")")} FROM customer
    UNION ALL SELECT DISTINCT c_custkey // 500, 1000000000000, 1, 'other', 'UPDATE client SET a = ''b''' FROM customer
  )
  SELECT shard, CAST(sum(n_pieces) OVER (PARTITION BY shard ORDER BY ord) - n_pieces AS BIGINT) AS stmt_no, kind, stmt FROM statements"""

# -- Questions ------------------------------------------------------------------------

QUESTIONS = f"""
  SELECT conv_id * 100 + turn AS index,
    CASE WHEN conv_id % 11 = 0 THEN '' WHEN conv_id % 13 = 0 THEN 'nodb' WHEN conv_id % 3 = 0 THEN 'db1'
      WHEN conv_id % 7 = 6 THEN '' ELSE 'db' || conv_id END AS db_id,
    CASE WHEN (conv_id + turn) % 17 = 0 THEN '' ELSE {_strip('text')} END AS question,
    CASE WHEN conv_id % 4 < 3 THEN 'SELECT count(*) FROM part_1' ELSE '' END AS gold_sql
  FROM conversations"""

ATTACHED = f"""
  SELECT q.*, s.schema_text, d.db_id IS NOT NULL AS has_schema_file
  FROM ({QUESTIONS}) q LEFT JOIN ({DATABASES}) d ON d.db_id = q.db_id
  LEFT JOIN ({SCHEMA_TEXT}) s ON s.db_id = q.db_id"""

VALIDATED = f"""
  SELECT a.*, CASE WHEN db_id = '' THEN 'Missing db_id in sample.'
      WHEN question = '' THEN 'Missing question in sample.'
      WHEN NOT has_schema_file THEN 'Schema SQL not found for db_id=''' || db_id || ''''
      WHEN schema_text IS NULL THEN 'No schema available to generate SQL' ELSE '' END AS error
  FROM ({ATTACHED}) a"""

_PROMPT = _filled(
    GENERATION_PROMPT.replace("{dialect}", "SQL"), schema="schema_text", question="question"
)
PROMPTS = f"SELECT index, db_id, question, gold_sql, schema_text, error, CASE WHEN error = '' THEN {_PROMPT} END AS prompt FROM ({VALIDATED}) v"

PREDICTED = f"""
  SELECT index, db_id, question, gold_sql,
    CASE WHEN error = '' AND n % 5 <> 0 AND n % 7 <> 0 THEN 'SELECT ' || n ELSE '' END AS predicted_sql,
    CASE WHEN error = '' AND n % 5 <> 0 AND n % 7 <> 0 THEN '500 tokens' ELSE '' END AS summary,
    CASE WHEN error = '' AND n % 5 <> 0 AND n % 7 <> 0 THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN error <> '' THEN error
      WHEN n % 5 = 0 THEN 'SQL generation failed: model is busy'
      WHEN n % 7 = 0 THEN 'SQL generation failed: Could not extract SQL from response: '
      ELSE '' END AS error
  FROM (SELECT *, length(prompt) AS n FROM ({PROMPTS}) p) m"""

_REVIEW_PROMPT = _filled(
    REVIEW_PROMPT, schema="schema_text", question="question", sql="predicted_sql"
)
REVIEW_PROMPTS = f"""
  SELECT p.index, p.predicted_sql, {_REVIEW_PROMPT} AS prompt
  FROM ({PREDICTED}) p JOIN ({REVIEW_TEXT}) s ON s.db_id = p.db_id WHERE p.status = 'ok'"""

# -- Replies, verdicts, predictions -----------------------------------------------------

_SELECT = "'SELECT o_totalprice FROM orders WHERE o_orderkey = ' || o_orderkey"
_JSON = "'{\"sql_query\": \"' || s || '\", \"summary\": \"' || o_orderpriority || '\"}'"
_BASE = f"(SELECT *, {_SELECT} AS s, o_orderkey % 12 AS v FROM orders) o"

PARSED = f"""
  SELECT o_orderkey AS index,
    CASE WHEN v IN (0, 1, 2, 3, 4, 5) THEN s
      WHEN v = 6 THEN '{{"summary": "' || o_orderpriority || '"}}'
      WHEN v = 7 THEN '{{"sql_query": "", "summary": "' || o_orderpriority || '"}}'
      WHEN v = 8 THEN ''
      WHEN v = 9 THEN '{{"sql_query": "' || s || '"'
      WHEN v = 10 THEN '{{"sql_query": null, "summary": "' || o_orderpriority || '"}}'
      ELSE {_JSON} || ' or {{"sql_query": "' || s || '"}}' END AS predicted_sql,
    CASE WHEN v < 4 THEN o_orderpriority WHEN v = 8 THEN '' ELSE 'SQL extracted from response' END AS summary,
    CASE WHEN v = 8 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN v = 8 THEN 'SQL generation failed: Could not extract SQL from response: ' ELSE '' END AS error
  FROM {_BASE}"""

PAYLOADS = f"""
  SELECT o_orderkey AS index,
    CASE WHEN v < 4 THEN s WHEN v = 7 THEN '' END AS sql_query,
    CASE WHEN v < 4 OR v IN (6, 7, 10) THEN o_orderpriority END AS summary,
    v < 4 OR v IN (6, 7, 10) AS is_object
  FROM {_BASE}"""

CLEAN_SQL = f"""
  SELECT o_orderkey AS index,
    CASE v WHEN 0 THEN {_JSON} WHEN 1 THEN 'json' || chr(10) || {_JSON} WHEN 2 THEN {_JSON}
      WHEN 3 THEN 'result=' || {_JSON} WHEN 4 THEN s WHEN 5 THEN s
      ELSE predicted_sql END AS sql
  FROM {_BASE} JOIN ({PARSED}) p ON p.index = o_orderkey"""

_VERDICTS = """(
  SELECT o_orderkey, o_orderkey % 9 AS v, 'SELECT ' || o_orderkey AS s FROM orders) o"""

REVIEWED = f"""
  SELECT o_orderkey AS index,
    CASE v WHEN 1 THEN s || ' + 1' WHEN 2 THEN s || ' + 3' WHEN 6 THEN s || ' + 2' WHEN 7 THEN s || ' + 1' WHEN 8 THEN s || ' + 1' ELSE s END AS sql,
    v IN (0, 1, 4, 5, 7, 8) AS reviewed,
    CASE v WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS rounds
  FROM {_VERDICTS}"""

VERDICTS = f"""
  SELECT o_orderkey AS index,
    CASE v WHEN 5 THEN 'sql' || chr(10) || 'FIXED: ' || s || ' + 1' WHEN 0 THEN 'VALID' WHEN 3 THEN 'INVALID'
      WHEN 4 THEN 'VALID' WHEN 6 THEN 'INVALID' WHEN 7 THEN 'FIXED: ' || s || ' + 1 FIXED:' WHEN 8 THEN 'FIXED:'
      ELSE 'FIXED: ' || s || ' + 1' END AS first,
    CASE v WHEN 0 THEN 'FIXED: ' || s || ' + 1' WHEN 1 THEN 'VALID' WHEN 2 THEN 'FIXED: ' || s || ' + 2' WHEN 3 THEN 'no'
      WHEN 4 THEN 'FIXED: ' || s || ' + 1' WHEN 5 THEN 'INVALID' WHEN 6 THEN 'FIXED: ' || s || ' + 2' WHEN 8 THEN 'FIXED: ' || s || ' + 1' ELSE 'VALID' END AS second
  FROM {_VERDICTS}"""

PREDICTIONS = f"""
  SELECT p.index, 'db' || o_custkey AS db_id,
    repeat('What is the price of order ' || o_orderkey || ' of priority ' || o_orderpriority || '? ', CAST(1 + o_orderkey % 3 AS INTEGER)) AS question,
    'SELECT ' || o_totalprice AS gold_sql, predicted_sql, summary, status, error,
    coalesce(round(abs(value), 3), 0.0) AS elapsed_sec
  FROM ({PARSED}) p JOIN orders ON o_orderkey = p.index LEFT JOIN events ON event_id = p.index"""

# -- Execution --------------------------------------------------------------------------

EXECUTED = """
  SELECT c_custkey AS index,
    CASE c_custkey % 13 WHEN 0 THEN 'rows' WHEN 1 THEN 'rows' WHEN 3 THEN 'empty' WHEN 11 THEN 'rows' ELSE 'error' END AS outcome,
    CASE c_custkey % 13
      WHEN 0 THEN (SELECT count(DISTINCT c_nationkey) FROM customer i WHERE i.c_mktsegment = c.c_mktsegment)
      WHEN 1 THEN (SELECT count(*) FROM nation) WHEN 11 THEN (SELECT count(*) FROM nation) ELSE 0 END AS n_rows,
    c_custkey % 13 NOT IN (0, 1, 3, 11) AS has_error
  FROM customer c"""

_SEGMENT_SQL = (
    "'SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = ''' || c_mktsegment "
    "|| ''' GROUP BY c_nationkey'"
)
EXECUTED_ROWS = f"""
  SELECT sha256(chr(10) || {_SEGMENT_SQL}) AS sql_key,
    '{{"c_nationkey":' || c_nationkey || ',"n":' || count(*) || '}}' AS row_json
  FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 13 = 0)
  GROUP BY c_mktsegment, c_nationkey
  UNION ALL
  SELECT sha256(chr(10) || 'WITH n AS (SELECT n_name FROM nation) SELECT * FROM n'),
    '{{"n_name":"' || n_name || '"}}' FROM nation
  UNION ALL
  SELECT sha256(chr(10) || 'SELECT n_name FROM IDENTIFIER(''nation'')'), '{{"n_name":"' || n_name || '"}}' FROM nation"""

# Members in the order of the dump; of those that share a whole key the first stays.
_FILE = "CAST(c_custkey // 500 AS VARCHAR)"
MEMBERS = f"""
  SELECT CAST(c_nationkey AS BIGINT) AS m_nation, nullif(c_custkey % 40, 7) AS m_code,
    CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS m_name, c_mktsegment AS m_segment, c_custkey AS m_customer,
    row_number() OVER (PARTITION BY c_nationkey, c_custkey % 40, c_custkey % 11 = 0 ORDER BY {_FILE}, c_custkey) AS turn
  FROM customer"""

# Here a database counts only if it has documents, so one without them is not found.
_SPARK_PROMPT = _filled(
    GENERATION_PROMPT.replace("{dialect}", "Spark SQL"), schema="schema_text", question="question"
)
ANSWERED = f"""
  SELECT index, CASE WHEN n IS NULL THEN 'error' ELSE 'ok' END AS status,
    CASE n % 3 WHEN 0 THEN 'SELECT r_regionkey FROM region WHERE r_regionkey < ' || n % 7
      WHEN 1 THEN 'SELECT upper(r_name) AS name FROM region WHERE r_regionkey > ' || n % 7
      WHEN 2 THEN 'SELECT nothing FROM region -- ' || n % 7 ELSE '' END AS sql,
    n IS NOT NULL AS reviewed,
    CASE n % 3 WHEN 0 THEN CASE WHEN n % 7 = 0 THEN 'empty' ELSE 'rows' END
      WHEN 1 THEN CASE WHEN n % 7 >= 4 THEN 'empty' ELSE 'rows' END WHEN 2 THEN 'error' END AS outcome,
    CASE n % 3 WHEN 0 THEN (SELECT count(*) FROM region WHERE r_regionkey < n % 7)
      WHEN 1 THEN (SELECT count(*) FROM region WHERE r_regionkey > n % 7) WHEN 2 THEN 0 END AS n_rows
  FROM (SELECT index, CASE WHEN error = '' THEN length({_SPARK_PROMPT}) END AS n FROM ({VALIDATED}) v) m"""

ORACLES = {
    "scan_questions": """
        SELECT 'db' || conv_id || '_' || turn AS db_id, unnest(string_split(text, chr(10))) AS question, role AS query,
          CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS index
        FROM conversations""",
    "scan_question_lines": f"""
        SELECT conv_id * 100 + turn AS index,
          CASE WHEN conv_id % 11 = 0 THEN '  ' WHEN conv_id % 13 = 0 THEN 'nodb'
            WHEN conv_id % 3 = 0 THEN ' db1' || chr(10) WHEN conv_id % 7 = 6 THEN NULL ELSE 'db' || conv_id END AS db_id,
          CASE WHEN (conv_id + turn) % 17 = 0 THEN ' ' || chr(10) ELSE '  ' || text || chr(10) END AS question,
          CASE WHEN conv_id % 4 < 3 THEN ' SELECT count(*) FROM part_1' || chr(10) END AS query
        FROM conversations""",
    "scan_dump_statements": f"SELECT shard, stmt_no, stmt FROM ({CLIENT_STATEMENTS}) s",
    "classify_statements": f"SELECT shard, stmt_no, kind FROM ({CLIENT_STATEMENTS}) s",
    "load_dump_rows": CLIENTS,
    "load_dump_articles": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "load_dump_numbered": """
        SELECT row_number() OVER (ORDER BY CAST(c_custkey // 500 AS VARCHAR), c_custkey) AS v_id, c_custkey, c_name
        FROM customer""",
    "load_dump_keys": f"""
        SELECT * EXCLUDE (turn) FROM ({MEMBERS}) m WHERE m_name IS NOT NULL AND (turn = 1 OR m_code IS NULL)""",
    "load_dump_refused": f"""
        SELECT 'member' AS table_name, CASE WHEN m_name IS NULL THEN 'missing value' ELSE 'duplicate key: m_nation, m_code' END AS error,
          count(*) AS n
        FROM ({MEMBERS}) m WHERE m_name IS NULL OR (turn > 1 AND m_code IS NOT NULL) GROUP BY ALL""",
    "load_dump_tally": f"""
        SELECT f.k AS t_file, c_mktsegment AS segment, count(*) AS n, 'first' AS note
        FROM (SELECT DISTINCT c_custkey // 500 AS k FROM customer) f JOIN customer ON {_FILE} <= CAST(f.k AS VARCHAR)
        GROUP BY f.k, c_mktsegment""",
    "load_dump_derived": f"""
        SELECT c_custkey, c_acctbal * 2 AS twice FROM customer
        WHERE c_acctbal > 5000 AND {_FILE} = (SELECT min({_FILE}) FROM customer)""",
    "load_dump_lines": """
        SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate)
        FROM lineitem""",
    "list_tables": f"SELECT db_id, 'part_' || p_partkey AS table_name FROM ({NORMALIZED}) d WHERE NOT is_view",
    "normalize_ddl": f"SELECT p_partkey, doc AS ddl FROM ({NORMALIZED}) d",
    "clean_ddl": CLEANED,
    "schema_docs": DOCS,
    "store_schema_docs": DOCS,
    "read_schema_docs": f"SELECT * FROM ({DOCS}) d WHERE db_id = 'db1'",
    "store_count_check": f"""
        SELECT 'db' || (p_partkey // 4) AS db_id, count(*) AS n_expected,
          CASE WHEN (p_partkey // 4) % 10 = 5 THEN 0 ELSE count(*) END AS n_stored, (p_partkey // 4) % 10 <> 5 AS ok
        FROM part GROUP BY p_partkey // 4""",
    "schema_text_by_db": SCHEMA_TEXT,
    "resolve_schema_file": """
        SELECT db_id, CASE WHEN bool_or(v = 0) THEN 'schema.sql' WHEN bool_or(v = 1) THEN db_id || '.sql'
          WHEN bool_or(v = 2) THEN min('a_' || doc_id || '.sql') FILTER (v = 2)
          ELSE min('z_' || doc_id || '.sql') FILTER (v = 3) END AS file_name
        FROM (SELECT doc_id, source || '_' || (doc_id // 60) AS db_id, doc_id // 20 % 5 AS v FROM documents) d
        WHERE v < 4 GROUP BY db_id""",
    "coerce_fields": QUESTIONS,
    "slice_questions": f"SELECT * FROM ({QUESTIONS}) q WHERE index >= 500 AND index < 2500",
    "resume_anti_join": f"""
        SELECT * FROM ({QUESTIONS}) q
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = index AND o_orderstatus = 'F')""",
    "distinct_databases": f"SELECT DISTINCT db_id FROM ({QUESTIONS}) q WHERE db_id <> ''",
    "attach_schema": ATTACHED,
    "attach_schema_salted": ATTACHED,
    "validate_rows": f"""
        SELECT index, CASE WHEN error = '' THEN 'ok' ELSE 'error' END AS status, error FROM ({VALIDATED}) v""",
    "build_prompt": f"SELECT index, prompt FROM ({PROMPTS}) p",
    "build_review_prompt": f"SELECT index, prompt FROM ({REVIEW_PROMPTS}) p",
    "generate_batch": f"""
        SELECT index,
          CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 7 = 0 THEN ''
            ELSE '{{"sql_query": "SELECT ' || n || '", "summary": "500 tokens"}}' END END AS reply,
          CASE WHEN n % 5 = 0 THEN 'model is busy' END AS error
        FROM (SELECT index, length(prompt) AS n FROM ({PROMPTS}) p) m""",
    "predict": PREDICTED,
    "run_batch": PREDICTED,
    "stream_predictions": PREDICTED,
    "review": f"""
        SELECT index, CASE WHEN length(prompt) % 5 = 0 THEN predicted_sql ELSE predicted_sql || ' LIMIT 1' END AS sql,
          length(prompt) % 5 <> 0 AS reviewed
        FROM ({REVIEW_PROMPTS}) p""",
    "extract_json_payload": PAYLOADS,
    "clean_sql_reply": CLEAN_SQL,
    "parse_reply": PARSED,
    "parse_reply_documents": f"""
        SELECT doc_id AS index, {_strip('text')} AS predicted_sql, source AS summary, 'ok' AS status, '' AS error FROM documents""",
    "parse_verdict": VERDICTS,
    "review_fold": REVIEWED,
    "completed_indices": f"SELECT index FROM ({PREDICTIONS}) p",
    "completed_indices_retry": f"SELECT index FROM ({PREDICTIONS}) p WHERE status = 'ok'",
    "append_predictions": f"SELECT * FROM ({PREDICTIONS}) p UNION ALL SELECT * FROM ({PREDICTIONS}) q",
    "export_csv": PREDICTIONS,
    "run_report": f"""
        SELECT count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error,
          round(avg(elapsed_sec), 6) AS avg_sec FROM ({PREDICTIONS}) p""",
    "preview": f"""
        SELECT index, db_id, CASE WHEN length(question) > 120 THEN substr(question, 1, 120) || '...' ELSE question END AS question,
          CASE WHEN length(predicted_sql) > 200 THEN substr(predicted_sql, 1, 200) || '...' ELSE predicted_sql END AS predicted_sql
        FROM ({PREDICTIONS}) p WHERE status = 'ok' ORDER BY index LIMIT 50""",
    "execute_outcomes": f"SELECT outcome, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ({EXECUTED}) e GROUP BY outcome",
    "execute_batch": EXECUTED,
    "execute_batch_rows": EXECUTED_ROWS,
    "answer_batch": ANSWERED,
    "ask": f"SELECT c_mktsegment, count(*) AS n, count(c_name) AS named FROM ({CLIENTS}) c GROUP BY c_mktsegment",
    **{key: check_sql(key) for key in SQL},
}
