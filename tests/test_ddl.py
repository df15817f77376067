"""DDL rewrites: hand-written results, and the same rules run by Python's re."""

import re

import pytest
from pyspark.sql import functions as F

from askloom.functions.ddl import (
    CLEAN_RULES,
    NORMALIZE_RULES,
    clean_ddl,
    normalize_ddl,
    statement_kind,
    strip_comments,
    strip_leading_comments,
    table_name,
)

NORMALIZED = {
    "CREATE TABLE `t` (\n  `a` int(11) NOT NULL,\n  `b` varchar(20) DEFAULT 'x'\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;":
        "CREATE TABLE t ( a int(11) NOT NULL, b TEXT DEFAULT 'x' ) ;",
    "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, n TINYINT(1), big BIGINT);":
        "CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER(1), big INTEGER);",
    "CREATE TABLE t (a INT AUTO_INCREMENT, b INT);":
        "CREATE TABLE t (a INT, b INT);",
    "CREATE TABLE t (a DATETIME, b TIMESTAMP DEFAULT CURRENT_TIMESTAMP);":
        "CREATE TABLE t (a TEXT, b TEXT DEFAULT CURRENT_TIMESTAMP);",
    "CREATE TABLE t (p DECIMAL(10,2) NOT NULL, q DECIMAL(10,2)x);":
        "CREATE TABLE t (p DECIMAL(10,2) NOT NULL, q REALx);",
    "CREATE TABLE t (a INT, -- it's a note\n b INT, /*!40101 hidden */ c INT,\n);":
        "CREATE TABLE t (a INT, b INT, c INT );",
    "CREATE TABLE t (a INT, FOREIGN KEY (a) REFERENCES u (a) ON DELETE CASCADE ON UPDATE SET NULL, b INT);":
        "CREATE TABLE t (a INT, FOREIGN KEY (a) REFERENCES u (a) , b INT);",
    "CREATE TABLE t (a INT, UNIQUE KEY ua (a), KEY kb (b), KEY kab (a, b));":
        "CREATE TABLE t (a INT, UNIQUE (a), KEY kab (a, b));",
    "CREATE TABLE t (a TEXT CHARACTER SET utf8 COLLATE=utf8_bin) =8192 ":
        "CREATE TABLE t (a TEXT )",
}

CLEANED = {
    "CREATE TABLE t ( a int(11) NOT NULL, p decimal(10,2), q DECIMAL(8, 3) );":
        "CREATE TABLE t ( a INTEGER(11) NOT NULL, p REAL, q REAL );",
    "CREATE TABLE t (a TEXT DEFAULT CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP, b TEXT ON UPDATE x y, c TEXT)":
        "CREATE TABLE t (a TEXT , b TEXT , c TEXT)",
    "CREATE TABLE t (a TEXT COLLATE utf8_bin CHARACTER SET utf8 COMMENT 'the, a', b TEXT, ) ENGINE=InnoDB AUTO_INCREMENT=7":
        "CREATE TABLE t (a TEXT , b TEXT)",
    "CREATE TABLE t (a TEXT, KEY `k` (a, b), UNIQUE KEY `u` (a))":
        "CREATE TABLE t (a TEXT, UNIQUE)",
    "CREATE TABLE t (a TEXT, UNIQUE KEY `u` (a))": "CREATE TABLE t (a TEXT, UNIQUE)",
    "CREATE TABLE point (print INT, int INT)": "CREATE TABLE point (print INTEGER, INTEGER INTEGER)",
}

MORE = [
    "CREATE TABLE t (größe INT, naïve varchar, x VARCHA(3), éint int)",
    "CREATE TABLE a (b INT PRIMARY KEY AUTO_INCREMENT) ENGINE=InnoDB AUTO_INCREMENT=8192 DEFAULT CHARSET=latin1",
    "CREATE TABLE a (b  INT AUTO_INCREMENT, c INT AUTO_INCREMENT)",
    "CREATE TABLE a (b INT) COLLATE = utf8 =8192 x",
    "CREATE TABLE a (b INT) = 12\n",
    "CREATE TABLE a (b INT -- last",
    "CREATE TABLE a (b INT) -- last\r\n -- more\n",
    "CREATE TABLE a (b\xa0INT, c INT) /* plain */ /*! x\ny */",
    "create table a (`b c` int, KEY `k` (`b c`), KEY k2 (b) , key k3 (c))",
    "CREATE TABLE a (b TEXT COMMENT 'on update now', c INT ON UPDATE CASCADE\n)",
    "CREATE TABLE a (b ENUM('x','y') CHARACTER  SET  latin1, c DATETIME ON UPDATE CURRENT_TIMESTAMP)",
]


def py_rules(rules, text):
    for pattern, replacement in rules:
        flags, body = re.match(r"(?:\(\?([a-zA-Z]+)\))?(.*)", pattern, re.S).groups()
        known = {"i": re.I, "s": re.S, "m": re.M}
        value = sum(known.get(f, 0) for f in flags or "")
        text = re.sub(body, replacement.replace("$", "\\"), text, flags=value)
    return " ".join(text.split())


def check(spark, function, pairs):
    df = spark.createDataFrame(pairs, "text string, want string")
    for row in df.select("*", function(F.col("text")).alias("got")).collect():
        assert row["got"] == row["want"], row["text"]


def test_normalize_by_hand(spark):
    check(spark, normalize_ddl, list(NORMALIZED.items()))


def test_clean_by_hand(spark):
    check(spark, clean_ddl, list(CLEANED.items()))


@pytest.mark.parametrize(
    "function,rules", [(normalize_ddl, NORMALIZE_RULES), (clean_ddl, CLEAN_RULES)]
)
def test_rules_mean_the_same_in_python(spark, function, rules):
    texts = [*NORMALIZED, *CLEANED, *MORE]
    check(spark, function, [(t, py_rules(rules, t)) for t in texts])


def test_kind_and_name(spark):
    cases = [
        ("CREATE TABLE t (a INT)", "create_table", "t"),
        ("create  table if not exists `My_T` (a INT)", "create_table", "My_T"),
        ("Insert\n into db.t (a) values (1)", "insert", "t"),
        ('INSERT INTO "t" VALUES (1)', "insert", "t"),
        ("INSERT IGNORE INTO t VALUES (1)", "other", ""),
        ("REPLACE INTO t VALUES (1)", "other", ""),
        ("CREATE TEMPORARY TABLE t (a INT)", "other", ""),
        ("CREATE INDEX i ON table_t (a)", "other", ""),
        ("DROP TABLE t", "other", ""),
    ]
    df = spark.createDataFrame(cases, "s string, kind string, name string")
    for row in df.select(
        "*", statement_kind(F.col("s")).alias("k"), table_name(F.col("s")).alias("n")
    ).collect():
        assert (row["k"], row["n"]) == (row["kind"], row["name"]), row["s"]


def test_comments(spark):
    check(
        spark,
        strip_comments,
        [
            ("a -- b\n c", "a \n c"),
            ("a '-- b' /* c\nd */ e", "a '-- b'  e"),
            ("'it''s -- x' -- it's", "'it''s -- x'"),
        ],
    )
    check(
        spark,
        strip_leading_comments,
        [("-- a\n/* b\n */ -- c\n CREATE -- d", "CREATE -- d"), ("-- a", ""), ("/*! x */", "")],
    )
    edges = [("-1", "-1"), ("/x", "/x"), ("a\u3000", "a"), ("\x85a", "a"), ("a /* b */", "a /* b */"), ("", ""), (" ", ""), (None, None)]
    check(spark, strip_leading_comments, edges)
