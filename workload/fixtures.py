"""Inputs that the given tables lack, derived from them by Spark.

Each fixture covers its whole table; a key modulo n only chooses the shape of a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.replies import parse_replies
from askloom.storage import new_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Views of the tables that a text names."""
    for table in set(re.findall(r"\w+", sql)) & set(TABLES):
        read(spark, sf_dir, table).createOrReplaceTempView(table)


# -- DDL: one statement per part, four to a database ------------------------------


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, db_id, stmt): every tenth database holds views and no table."""
    k = "cast(p_partkey as string)"
    shapes = [
        f"concat('-- Table structure for `part_', {k}, '`\\nCREATE TABLE `part_', {k},"
        " '` (\\n  `id` int(11) NOT NULL AUTO_INCREMENT,\\n  `label` varchar(', p_size,"
        " ') DEFAULT \\'', p_name, '\\',\\n  PRIMARY KEY (`id`),\\n  KEY `k_label` (`label`)\\n)"
        " ENGINE=InnoDB AUTO_INCREMENT=8192 DEFAULT CHARSET=utf8mb4')",
        f"concat('CREATE TABLE part_', {k}, ' (\\n  id INTEGER PRIMARY KEY AUTOINCREMENT,\\n"
        "  brand VARCHAR(25) NOT NULL,\\n  seen DATETIME,\\n  made TIMESTAMP DEFAULT"
        " CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP,\\n  stock BIGINT\\n)')",
        f"concat('CREATE TABLE part_', {k}, ' (\\n  id INT, -- the part\\'s number\\n"
        "  size TINYINT(1), -- from 1 to ', p_size, '\\n  -- no more\\n  brand VARCHAR(10),\\n)')",
        f"concat('CREATE TABLE part_', {k}, ' (\\n  id INT, owner INT,\\n"
        "  UNIQUE KEY u_owner (owner),\\n  FOREIGN KEY (owner) REFERENCES part_', p_size,"
        " ' (id) ON DELETE CASCADE ON UPDATE SET NULL\\n)')",
        f"concat('CREATE TABLE part_', {k}, ' (\\n  price DECIMAL(10,2) NOT NULL,\\n"
        "  note TEXT CHARACTER SET utf8 COLLATE=utf8_bin\\n)')",
        f"concat('create table part_', {k}, ' (id integer, ', lower(p_type), ' text)')",
        f"concat('CREATE TABLE part_', {k}, ' (id INT /*!50003 hidden */, kind VARCHAR(9)"
        " COMMENT \\'', p_type, '\\')')",
    ]
    shape = " ".join(f"WHEN p_partkey % 7 = {i} THEN {s}" for i, s in enumerate(shapes))
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "concat('db', p_partkey div 4) AS db_id",
        f"CASE WHEN (p_partkey div 4) % 10 = 5 THEN concat('CREATE VIEW part_', {k},"
        f" ' AS SELECT 1') {shape} END AS stmt",
    )


def ddl_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the form that reading a dump gives."""
    stmt = F.regexp_replace("stmt", r"^--[^\n]*\n", "")
    return ddl(spark, sf_dir).select(
        F.col("db_id").alias("path"),
        (F.col("p_partkey") % 4).alias("stmt_no"),
        F.lit(0).alias("part_no"),
        stmt.alias("stmt"),
    )


# -- Dumps --------------------------------------------------------------------------


def _quoted(c: Column) -> Column:
    text = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def _write_dump(
    rows: DataFrame, key: str, table: str, declaration: str, per_insert: int, per_file: int, closing: tuple[Column, ...] = ()
) -> str:
    """One dump file per ``per_file`` keys; its inserts hold ``per_insert`` keys each, and after
    them come the statements in ``closing``, which may name the file's ``shard``."""
    spark = rows.sparkSession
    columns = ", ".join(rows.columns)
    values = [
        _quoted(F.col(f.name))
        if f.dataType.simpleString() == "string"
        else F.coalesce(F.col(f.name).cast("string"), F.lit("NULL"))
        for f in rows.schema.fields
    ]
    one = F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")"))
    inserts = (
        rows.select(F.expr(f"{key} div {per_insert}").alias("block"), F.col(key).alias("k"), one.alias("t"))
        .groupBy("block")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "t")))["t"], ",\n").alias("tuples"))
        .select(
            F.expr(f"block div {per_file // per_insert}").alias("shard"),
            (F.col("block") + 2).alias("ord"),
            F.concat(F.lit(f"INSERT INTO {table} ({columns}) VALUES\n"), "tuples").alias("stmt"),
        )
    )
    shards = rows.select(F.expr(f"{key} div {per_file}").alias("shard")).distinct()
    around = shards.select(
        "shard",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("ord"), F.lit(f"-- it's a new file\nDROP TABLE IF EXISTS {table}").alias("stmt")),
                F.struct(F.lit(1).cast("long").alias("ord"), F.lit(f"CREATE TABLE {table} ({declaration})").alias("stmt")),
                F.struct(F.lit(1 << 40).alias("ord"), F.lit(f"UPDATE {table} SET a = 'b'").alias("stmt")),
                *[F.struct(F.lit((1 << 39) + i).alias("ord"), stmt.alias("stmt")) for i, stmt in enumerate(closing)],
            )
        ).alias("s"),
    ).select("shard", "s.*")
    folder = new_folder(spark, f"{table}-dump")
    (
        inserts.unionByName(around)
        .repartition("shard")
        .sortWithinPartitions("shard", "ord")
        .select("shard", F.concat("stmt", F.lit(";")).alias("value"))
        .write.partitionBy("shard")
        .text(folder)
    )
    return folder


def shard_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"shard=(\d+)", 1).cast("long")


CLIENT = (
    "c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(60), c_nationkey INT, "
    "c_acctbal DOUBLE, c_mktsegment VARCHAR(20) NOT NULL, KEY k (c_name)"
)


def client_dump(spark: SparkSession, sf_dir: str) -> str:
    """Customers with awkward names, 100 to an INSERT and 500 to a file."""
    name = F.expr(
        "CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN concat('O\\'', c_name)"
        " WHEN 2 THEN concat(c_name, ', (x)') WHEN 3 THEN concat(c_name, ';\\n-- ', c_mktsegment)"
        " WHEN 4 THEN 'NULL' END"
    )
    rows = read(spark, sf_dir, "customer").withColumn("c_name", name)
    return _write_dump(rows, "c_custkey", "client", CLIENT, 100, 500)


ARTICLE = "doc_id BIGINT, text TEXT, lang VARCHAR(2), source VARCHAR(10), n_chars BIGINT"


def article_dump(spark: SparkSession, sf_dir: str) -> str:
    """Documents with their whole texts, 20 to an INSERT and 200 to a file."""
    return _write_dump(read(spark, sf_dir, "documents"), "doc_id", "article", ARTICLE, 20, 200)


VISIT = "v_id INTEGER PRIMARY KEY AUTOINCREMENT, c_custkey BIGINT, c_name VARCHAR(60)"


def visit_dump(spark: SparkSession, sf_dir: str) -> str:
    """Customers as rows of a table whose key the inserts leave out."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return _write_dump(rows, "c_custkey", "visit", VISIT, 10, 500)


MEMBER = (
    "m_nation INT, m_code INT, m_name VARCHAR(60) NOT NULL, m_segment VARCHAR(20) DEFAULT 'none' NOT NULL, "
    "CONSTRAINT pk PRIMARY KEY (m_nation, m_code DESC), KEY k (m_name)"
)


def member_dump(spark: SparkSession, sf_dir: str) -> str:
    """Customers under keys that repeat within and across inserts and files, some of them null."""
    rows = read(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS m_nation", "nullif(c_custkey % 40, 7) AS m_code",
        "CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS m_name", "c_mktsegment AS m_segment", "c_custkey AS m_customer",
    )
    return _write_dump(rows, "m_customer", "member", MEMBER + ", m_customer BIGINT", 100, 500)


def tally_dump(spark: SparkSession, sf_dir: str) -> str:
    """Customers, and in each file statements that count those read so far and list some of them.

    The first file's list is the table; the others find it there. Every fourth count is repeated.
    """
    shard = F.col("shard").cast("string")
    count = F.concat(
        F.lit("INSERT INTO tally (t_file, segment, n) SELECT "), shard,
        F.lit(", c_mktsegment, count(*) FROM client GROUP BY c_mktsegment"),
    )
    again = F.concat(F.lit("INSERT INTO tally\n(SELECT t_file, segment, 0, 'again' FROM tally WHERE t_file = "), shard, F.lit(" AND n % 4 = 0)"))
    closing = (
        F.lit("CREATE TABLE tally (t_file INT, segment VARCHAR(20), n INT NOT NULL, note TEXT DEFAULT 'first', UNIQUE KEY u (t_file, segment))"),
        count,
        again,
        F.lit("CREATE TABLE IF NOT EXISTS rich AS\nSELECT c_custkey, c_acctbal * 2 AS twice FROM `client` WHERE c_acctbal > 5000"),
    )
    return _write_dump(read(spark, sf_dir, "customer"), "c_custkey", "client", CLIENT, 100, 500, closing)


LINE = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DECIMAL(12,2), l_extendedprice DECIMAL(12,2), l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag VARCHAR(1), l_linestatus VARCHAR(1), l_shipdate DATETIME, "
    "KEY k_line (l_orderkey, l_linenumber)"
)


def line_dump(spark: SparkSession, sf_dir: str) -> str:
    """Order lines, those of 50 orders to an INSERT and of 2,000 to a file."""
    rows = read(spark, sf_dir, "lineitem")
    rows = rows.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    return _write_dump(rows, "l_orderkey", "line", LINE, 50, 2000)


# -- Questions ----------------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, db_id, question, query) of all turns, a third of them for one database."""
    return (
        read(spark, sf_dir, "conversations")
        .selectExpr(
            "conv_id * 100 + turn AS index",
            "CASE WHEN conv_id % 11 = 0 THEN '  ' WHEN conv_id % 13 = 0 THEN 'nodb'"
            " WHEN conv_id % 3 = 0 THEN ' db1\\n' WHEN conv_id % 7 = 6 THEN NULL"
            " ELSE concat('db', conv_id) END AS db_id",
            "CASE WHEN (conv_id + turn) % 17 = 0 THEN ' \\n' ELSE concat('  ', text, '\\n') END AS question",
            "CASE WHEN conv_id % 4 < 3 THEN ' SELECT count(*) FROM part_1\\n' END AS query",
        )
    )


def question_sets(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files; each line is the JSON array of one turn's lines."""
    sample = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.concat(F.lit("db"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("db_id"),
            line.alias("question"),
            F.col("role").alias("query"),
            F.lit(1).alias("other"),
        ),
    )
    folder = new_folder(spark, "question-sets")
    read(spark, sf_dir, "conversations").select(F.to_json(sample).alias("value")).write.text(folder)
    return folder


# -- Replies, verdicts, predictions ---------------------------------------------------


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, reply) for each order, in twelve shapes."""
    s = "concat('SELECT o_totalprice FROM orders WHERE o_orderkey = ', o_orderkey)"
    j = f"concat('{{\"sql_query\": \"', {s}, '\", \"summary\": \"', o_orderpriority, '\"}}')"
    shapes = [
        j,
        f"concat('Here it is:\\n```json\\n', {j}, '\\n```\\nAnything else?')",
        f"concat('```\\n', {j}, '\\n```')",
        f"concat('result=', {j})",
        f"concat('Sure:\\n```sql\\n', {s}, '\\n```')",
        f"concat('-- order ', o_orderkey, '\\n', {s}, '\\n  -- done\\n/* ', o_orderpriority, ' */')",
        "concat('{\"summary\": \"', o_orderpriority, '\"}')",
        "concat('{\"sql_query\": \"\", \"summary\": \"', o_orderpriority, '\"}')",
        "' \\n'",
        f"concat('{{\"sql_query\": \"', {s}, '\"')",
        "concat('{\"sql_query\": null, \"summary\": \"', o_orderpriority, '\"}')",
        f"concat({j}, ' or {{\"sql_query\": \"', {s}, '\"}}')",
    ]
    shape = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS index", f"CASE o_orderkey % 12 {shape} END AS reply"
    )


def document_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, reply): each document's whole text as the SQL of a fenced reply."""
    payload = F.to_json(F.struct(F.col("text").alias("sql_query"), F.col("source").alias("summary")))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"),
        F.concat(F.lit("```json\n"), payload, F.lit("\n```")).alias("reply"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, sql, replies): three replies of a reviewer for each order."""
    s = "concat('SELECT ', o_orderkey)"
    fixed = [f"concat('FIXED: ', {s}, ' + {n}')" for n in (1, 2, 3)]
    shapes = [
        f"array('VALID', {fixed[0]}, 'VALID')",
        f"array({fixed[0]}, ' VALID\\n', {fixed[1]})",
        f"array({', '.join(fixed)})",
        "array('INVALID', 'no', 'INVALID')",
        f"array('```\\nVALID\\n```', {fixed[0]}, '')",
        f"array(concat('```sql\\n', {fixed[0]}, '\\n```'), '', 'VALID')",
        f"array('', concat('Try ```', {fixed[1]}, '```'), 'maybe')",
        f"array(concat({fixed[0]}, ' FIXED: '), 'VALID', 'VALID')",
        f"array('FIXED:', {fixed[0]}, 'VALID')",
    ]
    shape = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(shapes))
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS index", f"{s} AS sql", f"CASE o_orderkey % 9 {shape} END AS replies"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each order, with the seconds taken from the event of that id."""
    parsed = parse_replies(replies(spark, sf_dir)).drop("reply")
    seconds = read(spark, sf_dir, "events").selectExpr(
        "event_id AS index", "round(abs(value), 3) AS elapsed_sec"
    )
    orders = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS index",
        "concat('db', o_custkey) AS db_id",
        "repeat(concat('What is the price of order ', o_orderkey, ' of priority ', o_orderpriority,"
        " '? '), cast(1 + o_orderkey % 3 as int)) AS question",
        "concat('SELECT ', o_totalprice) AS gold_sql",
    )
    return (
        orders.join(parsed, "index")
        .join(seconds, "index", "left")
        .select("index", "db_id", "question", "gold_sql", "parsed.*", F.coalesce("elapsed_sec", F.lit(0.0)).alias("elapsed_sec"))
    )


# -- Stub models: functions of the prompt alone ---------------------------------------


def counting_model(settings):
    """Answers with the length of the prompt; fails or says nothing for some lengths."""
    import json

    def ask(prompts):
        if any(len(p) % 5 == 0 for p in prompts):
            raise RuntimeError("model is busy")
        return [
            "" if len(p) % 7 == 0 else json.dumps(
                {"sql_query": f"SELECT {len(p)}", "summary": f"{settings.max_tokens} tokens"}
            )
            for p in prompts
        ]

    return ask


def limiting_reviewer(settings):
    """Wants a LIMIT, rejects some SQL for good, and says nothing about some."""

    def check(prompt):
        sql = prompt.split("Generated SQL Query:\n", 1)[1].split("\n\nPlease respond", 1)[0]
        if sql.endswith("LIMIT 1"):
            return "VALID"
        if len(prompt) % 5 == 0:
            return "INVALID"
        return f"```\nFIXED: {sql} LIMIT 1\n```"

    return lambda prompts: [check(p) for p in prompts]


def region_model(settings):
    """Counts regions below a number taken from the prompt's length; at times says nothing of use."""
    kinds = [
        "SELECT r_regionkey FROM region WHERE r_regionkey < {}",
        "```sql\nSELECT r_name FROM region WHERE r_regionkey > {}\n```",
        "SELECT nothing FROM region -- {}",
    ]
    return lambda prompts: [kinds[len(p) % 3].format(len(p) % 7) for p in prompts]


def region_reviewer(settings):
    """Has the names in capitals, and finds no fault with the rest."""

    def check(prompt):
        sql = prompt.split("Generated SQL Query:\n", 1)[1].split("\n\nPlease respond", 1)[0]
        return "FIXED: " + sql.replace("r_name", "upper(r_name) AS name") if "SELECT r_name" in sql else "VALID"

    return lambda prompts: [check(p) for p in prompts]


def segment_model(settings):
    """Always counts the clients of each segment."""
    sql = "SELECT c_mktsegment, count(*) AS n, count(c_name) AS named FROM client GROUP BY c_mktsegment"
    return lambda prompts: ['{"sql_query": "%s", "summary": "clients"}' % sql for _ in prompts]


def agreeing_reviewer(settings):
    return lambda prompts: ["VALID"] * len(prompts)
