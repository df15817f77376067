"""Statements and rows of SQL dumps."""

import random
import re
from decimal import Decimal

import pytest

from askloom.operators.catalog import list_tables, schema_docs
from askloom.operators.load import TableColumn, _read_rows, dump_rows, load_dump, type_rows
from askloom.sources.dumps import scan_dump


CLOCK = re.compile(r"20\d\d-\d\d-\d\d \d\d:\d\d:\d\d")


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def statements(spark, path, **options):
    rows = scan_dump(spark, path, **options).orderBy("path", "stmt_no", "part_no").collect()
    return [r["stmt"] for r in rows]


def py_statements(text):
    """Character by character: the plain reading of a dump."""
    out, now, at = [], "", 0
    while at < len(text):
        rest = text[at:]
        if rest[0] in "'\"`" and rest[0] in rest[1:]:
            piece = rest[: rest.index(rest[0], 1) + 1]
        elif rest.startswith("--"):
            piece = rest.split("\n")[0]
        elif rest.startswith("/*") and "*/" in rest[2:]:
            piece = rest[: rest.index("*/", 2) + 2]
        elif rest[0] == ";":
            out.append(now)
            now, at = "", at + 1
            continue
        else:
            piece = rest[0]
        now, at = now + piece, at + len(piece)
    return [*out, now]


def py_leading(stmt):
    """Without the comments before it."""
    while True:
        stmt = stmt.strip()
        if stmt.startswith("--"):
            stmt = stmt.partition("\n")[2]
        elif stmt.startswith("/*") and "*/" in stmt[2:]:
            stmt = stmt[stmt.index("*/", 2) + 2 :]
        else:
            return stmt


MIXED = """-- it's a dump; really
DROP TABLE IF EXISTS t;
/*!40101 SET NAMES utf8 */;
/* plain; comment */ CREATE TABLE t (
  a INTEGER PRIMARY KEY, -- the key; isn't it
  b VARCHAR(50)
);
INSERT INTO t VALUES (1, 'x;
y'), (2, 'it''s;
''; -- not a comment;
'); INSERT INTO t VALUES (3, ';');
INSERT INTO t VALUES (4, "it's");
UPDATE t SET b = 'z'"""


def test_mixed_dump(spark, tmp_path):
    got = statements(spark, write(tmp_path, "mixed.sql", MIXED))
    assert [s.split("(")[0].strip() for s in got] == [
        "DROP TABLE IF EXISTS t",
        "CREATE TABLE t",
        "INSERT INTO t VALUES",
        "INSERT INTO t VALUES",
        "INSERT INTO t VALUES",
        "UPDATE t SET b = 'z'",
    ]
    assert "'it''s;\n''; -- not a comment;\n'" in got[2]


COMMENTED = """CREATE TABLE t (a INT);
/* not now:
INSERT INTO t VALUES (1, 'it''s');
-- */ INSERT INTO t VALUES (2);
/* INSERT INTO t VALUES (3);
it's off;
/* still off */ INSERT INTO t VALUES (4, '/* text;
*/'); /* end;
*/
INSERT INTO t VALUES (5);
"""


def test_separators_in_comments(spark, tmp_path):
    got = statements(spark, write(tmp_path, "c.sql", COMMENTED))
    assert got == [
        "CREATE TABLE t (a INT)",
        "INSERT INTO t VALUES (2)",
        "INSERT INTO t VALUES (4, '/* text;\n*/')",
        "INSERT INTO t VALUES (5)",
    ]


ESCAPED = r"""CREATE TABLE t (a INT, b TEXT);
INSERT INTO t VALUES (1, 'it\'s;
'), (2, 'c:\\'), (3, 'a\nb \\n \"q\" (x)');
INSERT INTO t VALUES (4, '\\\'');
"""


def test_backslash_escapes(spark, tmp_path):
    path = write(tmp_path, "e.sql", ESCAPED)
    loaded = load_dump(scan_dump(spark, path, backslash_escapes=True))
    rows = sorted(tuple(r) for r in loaded.tables["t"].collect())
    assert rows == [(1, "it's;\n"), (2, "c:\\"), (3, 'a\nb \\n "q" (x)'), (4, "\\'")]
    assert loaded.rejects.count() == 0


def test_windows_line_ends(spark, tmp_path):
    path = write(tmp_path, "w.sql", MIXED.replace("\n", "\r\n"))
    assert len(statements(spark, path, line_sep=";\r\n")) == 6
    assert len(statements(spark, path)) == 6


@pytest.mark.parametrize("split_bytes", [64, 257, 4096])
def test_any_split_size_gives_the_same(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    parts = ["'a;\nb'", "'it''s'", "';\n;\n'", "' -- x'", "-- it's ok\n", "/* it's; */",
             "/* a;\nb' */", "x", " ", "''", "/", "*/", "'/*'"]
    texts = []
    for n in range(6):
        made = []
        for i in range(120):
            made.append(f"S{i} " + " ".join(rng.choices(parts, k=rng.randint(0, 8))) + " e")
        texts.append(";\n".join(made) + rng.choice(["", ";", ";\n", ";\n\n"]))
    for n, text in enumerate(texts):
        write(tmp_path, f"d{n}.sql", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        rows = scan_dump(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for n, text in enumerate(texts):
        mine = sorted(
            (r["stmt_no"], r["part_no"], r["stmt"]) for r in rows if r["path"].endswith(f"d{n}.sql")
        )
        want = [py_leading(s) for s in py_statements(text) if py_leading(s)]
        assert [s for _, _, s in mine] == want


DUMP = """
CREATE TABLE Shop (
  `id` INTEGER PRIMARY KEY AUTOINCREMENT,
  name VARCHAR(50) NOT NULL COMMENT 'a, b',
  price DECIMAL(10,2),
  rate DOUBLE,
  status VARCHAR(20) DEFAULT 'pen''ding',
  gdp BIGINT,
  made DATETIME DEFAULT CURRENT_TIMESTAMP,
  CONSTRAINT c CHECK (price > (1 + 1)),
  KEY k (name, price),
  UNIQUE (id),
  FOREIGN KEY (id) REFERENCES other(id) ON DELETE CASCADE
);
INSERT INTO shop (id, name, price, rate, status, gdp, made) VALUES
(1, 'plain', 12.50, 1.5e3, 'open', 188681000000, '2020-01-01'), -- it's fine
(2, 'it''s, (odd) ;
-- text', NULL, -.5, 'NULL', -3, null),
(3, '', 0.1, 1, '', 0, '');
INSERT INTO `SHOP` (name, id) VALUES ('short', 4);
INSERT INTO shop VALUES (5,'all',1,2,'s',3,'m');
INSERT INTO shop VALUES (6,'few');
INSERT INTO shop (id, nope) VALUES (7, 1);
INSERT INTO shop (id, name) VALUES (8, now()), (9, 'good');
INSERT INTO shop (id, name) VALUES ('x', 'bad id');
INSERT INTO shop (id, name) SELECT 1, 'a';
INSERT INTO missing VALUES (1);
INSERT IGNORE INTO shop VALUES (99);
"""


def test_load(spark, tmp_path):
    loaded = load_dump(scan_dump(spark, write(tmp_path, "shop.sql", DUMP)))
    assert loaded.register() == ["shop"]
    table = loaded.tables["shop"]
    assert dict(table.dtypes) == {
        "id": "bigint", "name": "string", "price": "decimal(10,2)", "rate": "double",
        "status": "string", "gdp": "bigint", "made": "string",
    }
    rows = [
        tuple("now" if isinstance(v, str) and CLOCK.fullmatch(v) else v for v in r)
        for r in spark.sql("SELECT * FROM shop ORDER BY id").collect()
    ]
    assert rows == [
        (1, "plain", Decimal("12.50"), 1500.0, "open", 188681000000, "2020-01-01"),
        (2, "it's, (odd) ;\n-- text", None, -0.5, "NULL", -3, None),
        (3, "", Decimal("0.10"), 1.0, "", 0, ""),
        (4, "short", None, None, "pen'ding", None, "now"),
        (5, "all", Decimal("1.00"), 2.0, "s", 3, "m"),
        (9, "good", None, None, "pen'ding", None, "now"),
    ]
    rejects = sorted((r["table_name"], r["error"]) for r in loaded.rejects.collect())
    assert rejects == [
        ("missing", "no such table"),
        ("shop", "duplicate key: id"),  # of the row that is selected
        ("shop", "not a constant"),
        ("shop", "unknown column"),
        ("shop", "value does not fit its column"),
        ("shop", "wrong number of values"),
    ]


def test_quotes_and_parentheses(spark, tmp_path):
    text = """CREATE TABLE `t` (
  `id` int(11) NOT NULL COMMENT 'the (id), and more',
  name VARCHAR(20) DEFAULT "a, (b)", -- "quoted
  size ENUM('s', 'm (x)') CHECK (size IN ('s', lower('M (X)'))),
  "key" TEXT
) ENGINE=InnoDB COMMENT='about (t), and so on';
INSERT INTO t VALUES (1, "it's ""so"", (1)", 's', "x"), (2, 'say "hi"', "m", '');
INSERT INTO t (id, "key") VALUES (3, "-- no comment");
"""
    loaded = load_dump(scan_dump(spark, write(tmp_path, "q.sql", text)))
    table = loaded.tables["t"]
    assert table.columns == ["id", "name", "size", "key"]
    assert sorted(map(tuple, table.collect())) == [
        (1, "it's \"so\", (1)", "s", "x"),
        (2, 'say "hi"', "m", ""),
        (3, "a, (b)", None, "-- no comment"),
    ]
    assert loaded.rejects.count() == 0


# Tuples of (a BIGINT, b DOUBLE, c TEXT DEFAULT 'it''s', d DECIMAL(6,2) NOT NULL): whether they are plain, and what is read.
TUPLES = [
    ("(1, 2.5, 'x', 3)", True, (1, 2.5, "x", Decimal("3.00"))),
    ("(+1,-.5,' x ',3.)", True, (1, -0.5, " x ", Decimal("3.00"))),
    ("(NULL, 1e3, 'is NULL', 0.005)", True, (None, 1000.0, "is NULL", Decimal("0.01"))),
    ("(1, NULL, '', 3)", True, (1, None, "", Decimal("3.00"))),
    ("('7', '1', 'a(b)', '2')", True, (7, 1.0, "a(b)", Decimal("2.00"))),
    ("(1, 2, 'x', NULL)", True, "missing value"),
    ("(1.5, 2, 'x', 3)", True, "value does not fit its column"),
    ("(NULL, 'z', NULL, 3)", True, "value does not fit its column"),
    ("(1, 2, 'x')", True, "wrong number of values"),
    ("(1, 2, 'NULL', 3)", False, (1, 2.0, "NULL", Decimal("3.00"))),
    ("(1, 2, null, 3)", False, (1, 2.0, None, Decimal("3.00"))),
    ("(1, 2, 'a, b', 3)", False, (1, 2.0, "a, b", Decimal("3.00"))),
    ("(1, 2, 'a''b', 3)", False, (1, 2.0, "a'b", Decimal("3.00"))),
    ("(1, 2, \"a\", 3)", False, (1, 2.0, "a", Decimal("3.00"))),
    ("( 1 , 2,  'x', TRUE)", False, (1, 2.0, "x", Decimal("1.00"))),
    ("(1, 2, 'x'\n, 0x10)", False, (1, 2.0, "x", Decimal("16.00"))),
    ("(1, 2, now(), 3)", False, "not a constant"),
    ("(1 2, 2, 'x', 3)", False, "not a constant"),
    ("()", False, "wrong number of values"),
]


@pytest.mark.parametrize("deep", [False, True])
def test_plain_tuples_are_cut_at_their_commas(spark, deep):
    columns = [TableColumn("a", "bigint"), TableColumn("b", "double"), TableColumn("c", "string", "'it''s'")]
    columns.append(TableColumn("d", "decimal(6,2)", required=True))
    stmt = "INSERT INTO t VALUES " + ",\n".join(t for t, _, _ in TUPLES)
    stmts = spark.createDataFrame([("p", 1, 0, stmt)], "path string, stmt_no long, part_no int, stmt string")
    rows = _read_rows(stmts, deep)
    # Their constants are not told apart one by one: they have no fields.
    assert [(r["fields"] is None) for r in rows.orderBy("row_no").collect()] == [plain for _, plain, _ in TUPLES]
    for read in (rows, dump_rows(stmts, deep)):
        typed = type_rows(read, columns).orderBy("__row_no").collect()
        assert [r["__error"] or (r["a"], r["b"], r["c"], r["d"]) for r in typed] == [want for _, _, want in TUPLES]
        assert [r["__source"] for r in typed] == [t if isinstance(want, str) else None for t, _, want in TUPLES]


def test_plain_tuples_in_another_order(spark):
    columns = [TableColumn("a", "bigint"), TableColumn("b", "string", "'it''s'"), TableColumn("c", "bigint", "5")]
    stmts = [
        ("p", i, 0, f"INSERT INTO t ({names}) VALUES {t}")
        for i, (names, t) in enumerate([("c, a", "(1, NULL)"), ("b, A", "('x', 2)"), ("a, b, c", "(1, 'y', 2)"), ("a, z", "(1, 2)"), ("a", "(1, 2)")])
    ]
    stmts = spark.createDataFrame(stmts, "path string, stmt_no long, part_no int, stmt string")
    for read in (_read_rows(stmts, False), dump_rows(stmts, False)):
        typed = type_rows(read, columns).orderBy("__stmt_no").collect()
        assert [r["__error"] or (r["a"], r["b"], r["c"]) for r in typed] == [
            (None, "it's", 1), (2, "x", 5), (1, "y", 2), "unknown column", "wrong number of values",
        ]


def py_numbers(keys):
    out, top = [], 0
    for k in keys:
        out.append(top + 1 if k is None else k)
        top = max(top, out[-1])
    return out


@pytest.mark.parametrize("declaration", ["id INTEGER PRIMARY KEY", "id int NOT NULL, PRIMARY KEY (`id`)"])
def test_missing_keys_are_numbered(spark, tmp_path, declaration):
    rng = random.Random(5)
    text, keys, n = f"CREATE TABLE t ({declaration}, v INT);\n", [], 0
    for i in range(700):
        rows = rng.randint(1, 3)
        if rng.random() < 0.6:
            given = [None] * rows
            values = [f"({n + j})" for j in range(rows)]
            text += f"INSERT INTO t (v) VALUES {', '.join(values)};\n"
        else:
            given = [None if rng.random() < 0.3 else rng.choice([len(keys) + j, 5000 + i, -7]) for j in range(rows)]
            values = [f"({'NULL' if k is None else k}, {n + j})" for j, k in enumerate(given)]
            text += f"INSERT INTO t VALUES {','.join(values)};\n"
        keys, n = keys + given, n + rows
    loaded = load_dump(scan_dump(spark, write(tmp_path, "t.sql", text)))
    got = loaded.tables["t"].orderBy("v").collect()
    assert [r["id"] for r in got] == list(dict.fromkeys(py_numbers(keys)))  # of equal keys the first row's
    assert loaded.tables["t"].columns == ["id", "v"]


def test_other_keys_stay_null(spark, tmp_path):
    text = """CREATE TABLE t (id int(11) PRIMARY KEY, v INT);
INSERT INTO t (v) VALUES (1);
CREATE TABLE u (id INTEGER, w INTEGER, PRIMARY KEY (id, w));
INSERT INTO u (id) VALUES (1);
"""
    loaded = load_dump(scan_dump(spark, write(tmp_path, "t.sql", text)))
    assert [tuple(r) for r in loaded.tables["t"].collect()] == [(None, 1)]
    assert [tuple(r) for r in loaded.tables["u"].collect()] == [(1, None)]


def test_save(spark, tmp_path):
    load_dump(scan_dump(spark, write(tmp_path, "shop.sql", DUMP))).save("saved_dump")
    assert spark.sql("SELECT count(*) FROM saved_dump.shop").first()[0] == 6


SAMPLES = {
    "garden": """-- beds and what grows in them
DROP TABLE IF EXISTS Bed;
CREATE TABLE Bed (
    label VARCHAR(20) PRIMARY KEY,
    soil VARCHAR(9),
    square_metres INT,
    litres BIGINT
);
INSERT INTO Bed VALUES ('north', 'clay', 12, 340), ('south', 'sand', 7, 90);
""",
    "tides": """CREATE TABLE Port (code INTEGER PRIMARY KEY, title VARCHAR(30) NOT NULL);
CREATE TABLE Tide (no INTEGER PRIMARY KEY, height INT, port INT,
  FOREIGN KEY (port) REFERENCES Port(code));
INSERT INTO Port (code, title) VALUES (4, 'East'), (9, 'West');
""",
}


def test_docs_of_several_dumps(spark, tmp_path):
    for name, text in SAMPLES.items():
        write(tmp_path, f"{name}.sql", text)
    found = scan_dump(spark, str(tmp_path))
    docs = schema_docs(found).orderBy("db_id", "doc_no").collect()
    assert [tuple(d) for d in docs] == [
        ("garden", 0, "schema_doc_0",
         "CREATE TABLE Bed ( label TEXT PRIMARY KEY, soil TEXT, square_metres INT, litres INTEGER );"),
        ("tides", 0, "schema_doc_0",
         "CREATE TABLE Port (code INTEGER PRIMARY KEY, title TEXT NOT NULL);"),
        ("tides", 1, "schema_doc_1",
         "CREATE TABLE Tide (no INTEGER PRIMARY KEY, height INT, port INT, "
         "FOREIGN KEY (port) REFERENCES Port(code));"),
    ]
    tables = sorted(tuple(r) for r in list_tables(found).collect())
    assert tables == [("garden", "Bed"), ("tides", "Port"), ("tides", "Tide")]


ODD_DUMP = """# it's a note; with a quote
CREATE TABLE t (id INT, note TEXT, CHECK (((((((((((id + 1)))))))))) > 0));
# note before an insert
INSERT INTO t VALUES (1, "a;
b"), (2, 'x');
INSERT INTO t VALUES (3, `odd;
name`), (4, (((((1)))))), (5, 'after');
CREATE TRIGGER log AFTER INSERT ON t BEGIN
  INSERT INTO t VALUES (91, 'in a trigger');
  UPDATE t SET note = CASE WHEN id > 1 THEN 'a;
b' ELSE 'c' END;
  INSERT INTO t VALUES (92, 'still there');
END;
INSERT INTO t VALUES (6, 'last');
CREATE TRIGGER one BEFORE DELETE ON t BEGIN INSERT INTO t VALUES (93, 'x'); END;
INSERT INTO t VALUES (7, TRUE), (8, 0xFF), (9, x'414243'), (10, FALSE), (11, CURRENT_TIMESTAMP);
"""


@pytest.mark.parametrize("size", [None, "60b"])
def test_what_a_dump_holds_is_loaded_or_rejected(spark, tmp_path, size):
    path = write(tmp_path, "odd.sql", ODD_DUMP)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        loaded = load_dump(scan_dump(spark, path))
        rows = {r["id"]: r["note"] for r in loaded.tables["t"].collect()}
        rejects = sorted((r["source"], r["error"]) for r in loaded.rejects.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert CLOCK.fullmatch(rows.pop(11))
    assert rows == {1: "a;\nb", 2: "x", 5: "after", 6: "last", 7: "1", 8: "255", 9: "ABC", 10: "0"}
    assert rejects == [("(3, `odd;\nname`)", "not a constant"), ("(4, (((((1))))))", "not a constant")]


def test_escapes_in_double_quotes(spark, tmp_path):
    text = 'CREATE TABLE t (id INT, note TEXT);\nINSERT INTO t VALUES (1, "a\\"b;\nc"), (2, \'it\\\'s\');\n'
    found = scan_dump(spark, write(tmp_path, "escaped.sql", text), backslash_escapes=True)
    loaded = load_dump(found)
    assert {r["id"]: r["note"] for r in loaded.tables["t"].collect()} == {1: 'a"b;\nc', 2: "it's"}
    assert loaded.rejects.isEmpty()


def test_long_decimals_are_texts(spark, tmp_path):
    text = "CREATE TABLE t (a DECIMAL(65,30), b DECIMAL(4,9), c DECIMAL(5,2));\nINSERT INTO t VALUES (1.5, 2.5, 3.5);\n"
    row = load_dump(scan_dump(spark, write(tmp_path, "long.sql", text))).tables["t"].first()
    assert tuple(row) == ("1.5", "2.5", Decimal("3.50"))


def test_a_table_that_fails_stops_no_other(spark, tmp_path):
    text = "CREATE TABLE bad (a INT, A INT);\nCREATE TABLE good (a INT);\nINSERT INTO bad VALUES (1, 2);\nINSERT INTO good VALUES (3);\n"
    loaded = load_dump(scan_dump(spark, write(tmp_path, "two.sql", text)))
    assert [r["a"] for r in loaded.tables["good"].collect()] == [3] and "bad" not in loaded.tables
    assert [(r["table_name"], r["source"]) for r in loaded.rejects.collect()] == [("bad", "(1, 2)")]


def test_numbering_needs_no_single_task(spark, tmp_path):
    values = ", ".join("('x')" for _ in range(3000))
    text = (
        "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT);\nINSERT INTO t (v) VALUES " + values
        + ";\nINSERT INTO t VALUES (5000, 'y');\nINSERT INTO t (v) VALUES ('z'), ('z');\n"
    )
    table = load_dump(scan_dump(spark, write(tmp_path, "many.sql", text))).tables["t"]
    assert sorted(r["id"] for r in table.collect()) == [*range(1, 3001), 5000, 5001, 5002]


def test_an_unclosed_quote_costs_one_statement(spark, tmp_path):
    good = "".join(f"CREATE TABLE t{k} (id INT, name TEXT);\nINSERT INTO t{k} VALUES ({k}, 'a{k}'), (1, 'it''s;\n');\n" for k in range(60))
    spoilt = "INSERT INTO t3 VALUES (7, 'it's);\n" + good + 'INSERT INTO t4 VALUES (8, "open);\nCREATE TABLE last (id INT);\n' + "/* never closed; INSERT INTO t1 VALUES (9, 'x');\n"
    for n, limit in enumerate((2_000_000_000, 300)):
        path = write(tmp_path, f"spoilt{n}.sql", good.replace("t", "u", 1) + spoilt)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        try:
            loaded = load_dump(scan_dump(spark, path, max_statement_bytes=limit))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for k in range(60):
            rows = [tuple(r) for r in loaded.tables[f"t{k}"].collect()]
            assert rows.count((k, f"a{k}")) >= 1 and (1, "it's;\n") in rows
        assert "last" in loaded.tables
        sources = {r["source"][:34] for r in loaded.rejects.collect()}
        assert any("it's" in s for s in sources) and any("open" in s for s in sources)


def test_a_statement_that_is_too_long_is_given_up(spark, tmp_path):
    long = "INSERT INTO t VALUES ('" + "x;\n" * 400 + "');\n"
    text = "CREATE TABLE t (a TEXT);\nINSERT INTO t VALUES ('one');\n" + long + "INSERT INTO t VALUES ('two');\n"
    whole = load_dump(scan_dump(spark, write(tmp_path, "long.sql", text))).tables["t"].collect()
    assert sorted(len(r["a"]) for r in whole) == [3, 3, 1200]
    cut = load_dump(scan_dump(spark, write(tmp_path, "cut.sql", text), max_statement_bytes=1000)).tables["t"].collect()
    assert sorted(r["a"] for r in cut) == ["one", "two"]
