"""Constraints and derived statements of loaded dumps, against rows taken one after the other."""

import random
import sqlite3
from pathlib import Path

import pytest

from askloom.operators import guard, joins, keys
from askloom.operators import load as loading
from askloom.operators.load import declared_keys, declared_tables, load_dump
from askloom.sources.dumps import scan_dump


def load(spark, folder, *files):
    for n, text in enumerate(files):
        (folder / f"{n:03}.sql").write_text(text, encoding="utf-8")
    return load_dump(scan_dump(spark, str(folder)))


def table(loaded, name):
    return sorted(map(str, map(tuple, loaded.tables[name].collect())))


def reasons(loaded):
    return sorted((r.table_name, r.error) for r in loaded.rejects.collect())


DECLARATIONS = """CREATE TABLE a (id INT PRIMARY KEY, x TEXT DEFAULT 'unique' NOT NULL, y INT UNIQUE, z INT);
CREATE TABLE b (p INT, q INT NOT NULL, r VARCHAR(9), PRIMARY KEY (p, q DESC), UNIQUE KEY `u` (`r`(4)),
  CONSTRAINT c UNIQUE INDEX v USING BTREE (q, r), KEY k (p), unique (p, q));
CREATE TABLE c (unique_id INT, t TEXT, CHECK (t <> 'not null'), FOREIGN KEY (unique_id) REFERENCES a (id));
"""


def test_declared_keys(spark, tmp_path):
    (tmp_path / "d.sql").write_text(DECLARATIONS)
    found = scan_dump(spark, str(tmp_path / "d.sql"))
    assert declared_keys(found) == {"a": [("id",), ("y",)], "b": [("p", "q"), ("r",), ("q", "r")]}
    required = {name: [c.name for c in columns if c.required] for name, columns in declared_tables(found).items()}
    assert required == {"a": ["x"], "b": ["q"], "c": []}


def one_after_the_other(rows):
    """SQLite takes the rows, each on its own."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (a TEXT, b INT, c TEXT NOT NULL, n INT, PRIMARY KEY (a, b), UNIQUE (c), UNIQUE (n))")
    for row in rows:
        try:
            con.execute("INSERT INTO t VALUES (?, ?, ?, ?)", row)
        except sqlite3.IntegrityError:
            pass
    return sorted(map(str, con.execute("SELECT * FROM t").fetchall()))


def literal(value):
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


@pytest.mark.parametrize("seed,n,spread", [(1, 400, 12), (2, 300, 60), (3, 200, 3), (4, 0, 1)])
def test_first_rows_stay(spark, tmp_path, monkeypatch, seed, n, spread):
    random_ = random.Random(seed)

    def some(make):
        return None if random_.random() < 0.1 else make(random_.randrange(spread))

    rows = [(some(lambda k: f"a{k % 4}"), some(int), some(lambda k: f"c{k * 7 % 50}"), some(lambda k: k * k)) for _ in range(n)]
    if seed == 2:  # as if the lookup tables were too large to broadcast
        monkeypatch.setattr(joins, "small_enough", lambda *_: False)
    head = "CREATE TABLE t (a TEXT, b INT, c TEXT NOT NULL, n INT, PRIMARY KEY (a, b), UNIQUE (c), UNIQUE KEY k (n));\n"
    files = []
    for at in range(0, max(n, 1), 72):
        inserts = [rows[i : i + 9] for i in range(at, min(n, at + 72), 9)]
        files.append(head + "".join(f"INSERT INTO t VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in some_rows)};\n" for some_rows in inserts))
    loaded = load(spark, tmp_path, *files)
    kept = one_after_the_other(rows)
    assert table(loaded, "t") == kept
    assert len(reasons(loaded)) == n - len(kept)
    assert {e.split(":")[0] for _, e in reasons(loaded)} <= {"missing value", keys.DUPLICATE}


def test_a_chain_of_repeats(spark, tmp_path):
    """Each row repeats a key of the one before it, so every second one stays."""
    rows = [(k // 2, 1000 + (k + 1) // 2) for k in range(21)]
    text = "CREATE TABLE t (a INT UNIQUE, b INT UNIQUE);\n" + "".join(f"INSERT INTO t VALUES {r};\n" for r in rows)
    assert table(load(spark, tmp_path, text), "t") == sorted(map(str, rows[::2]))


def test_numbers_and_keys(spark, tmp_path):
    text = (
        "CREATE TABLE t (id INTEGER PRIMARY KEY AUTO_INCREMENT, m TEXT NOT NULL);\n"
        "INSERT INTO t (m) VALUES ('a'), (NULL), ('b');\nINSERT INTO t VALUES (2, 'again'), (7, 'c'), (NULL, 'd'), (7, 'e');\n"
    )
    loaded = load(spark, tmp_path, text)
    assert table(loaded, "t") == ["(1, 'a')", "(2, 'b')", "(7, 'c')", "(8, 'd')"]
    assert reasons(loaded) == [("t", "duplicate key: id"), ("t", "duplicate key: id"), ("t", "missing value")]
    sources = {r.source for r in loaded.rejects.where("error LIKE 'duplicate%'").collect()}
    assert sources == {'{"id":2,"m":"again"}', '{"id":7,"m":"e"}'}


SHOP = [
    """CREATE TABLE item (id INT, kind TEXT, price DOUBLE NOT NULL, UNIQUE (id));
CREATE TABLE total (kind TEXT UNIQUE, n INT NOT NULL, note TEXT DEFAULT 'none');
INSERT INTO item VALUES (1, 'a', 1.5), (2, 'b', 2.0), (2, 'c', 9.0), (3, 'a', NULL);
INSERT INTO total (n, kind) SELECT count(*), kind FROM item GROUP BY kind ORDER BY kind;
INSERT INTO item VALUES (4, 'b', 4.0), (5, 'd', 5.0);
INSERT INTO later VALUES (0, 0.0);
CREATE TABLE later AS SELECT id, price * 2 AS twice FROM item WHERE id > 1;
INSERT INTO later VALUES (100, 0.5);
""",
    """INSERT INTO total
(SELECT kind, count(*), 'again' FROM item GROUP BY kind);
INSERT INTO later WITH x AS (SELECT max(id) AS m FROM later) SELECT m + 1, NULL FROM x;
CREATE TABLE IF NOT EXISTS later AS SELECT 1 AS one;
CREATE TABLE later AS SELECT 1 AS one;
INSERT INTO total SELECT 'only one';
INSERT INTO nowhere SELECT 1;
INSERT INTO total SELECT kind, 'many' FROM item;
INSERT INTO total (kind, n) SELECT 'x', NULL;
INSERT INTO item SELECT 9, java_method('java.lang.System', 'lineSeparator'), 1;
CREATE TABLE stolen AS SELECT * FROM text.`/etc/hostname`;
INSERT INTO total (kind, n) SELECT 'caf;e', 1 FROM item WHERE 1 = 0;
""",
]


def test_statements_that_make_rows_from_rows(spark, tmp_path):
    spark.sql("SELECT 'outside' AS kind").createOrReplaceTempView("item")
    loaded = load(spark, tmp_path, *SHOP)
    assert table(loaded, "item") == ["(1, 'a', 1.5)", "(2, 'b', 2.0)", "(4, 'b', 4.0)", "(5, 'd', 5.0)"]
    assert table(loaded, "total") == ["('a', 1, 'none')", "('b', 1, 'none')", "('d', 1, 'again')"]
    assert table(loaded, "later") == ["(100, 0.5)", "(101, None)", "(2, 4.0)", "(4, 8.0)", "(5, 10.0)"]
    assert set(loaded.tables) == {"item", "total", "later"}
    assert spark.table("item").first()["kind"] == "outside"
    found = [(t, e.split("\n")[0][:60]) for t, e in reasons(loaded)]
    assert found.count(("total", "duplicate key: kind")) == 2
    assert ("later", "no such table") in found and ("later", "table later exists.") in found
    assert ("nowhere", "no such table: nowhere.") in found
    assert ("total", "1 values for 3 columns.") in found and ("total", "2 values for 3 columns.") in found
    assert ("total", "missing value") in found and ("item", "missing value") in found
    assert any(t == "item" and "reflection" in e for t, e in found) and any(t == "stolen" and "no table" in e for t, e in found)
    assert len(loaded.declarations.collect()) == 6


def test_derived_rows_meet_later_ones(spark, tmp_path):
    text = (
        "CREATE TABLE s (id INT, v TEXT);\nCREATE TABLE t (id INT UNIQUE, v TEXT);\nINSERT INTO s VALUES (1, 'x'), (2, 'y');\n"
        "INSERT INTO t VALUES (1, 'first');\nINSERT INTO t SELECT id, v FROM s;\nINSERT INTO t VALUES (2, 'late'), (3, 'z');\n"
    )
    assert table(load(spark, tmp_path, text), "t") == ["(1, 'first')", "(2, 'y')", "(3, 'z')"]


def test_statements_run_together_as_if_one_after_the_other(spark, tmp_path):
    """Sums over what is there so far, rows that depend on them, a chain in which each needs the one before."""
    texts = [
        "CREATE TABLE s (id INT, v INT);\nCREATE TABLE t (file INT UNIQUE, n INT, note TEXT);\nCREATE TABLE c (id INT UNIQUE);\nINSERT INTO c VALUES (0);\n"
    ]
    for i in range(12):
        texts.append(
            f"INSERT INTO s VALUES ({i}, {i % 5});\nINSERT INTO t SELECT {i}, count(*), 'first' FROM s;\n"
            f"INSERT INTO t SELECT file, 0, 'again' FROM t WHERE file = {i};\n"
            f"INSERT INTO t SELECT 100 + {i}, n, 'copy' FROM t WHERE file = {i} AND n % 6 = 0;\n"
        )
    texts.append("INSERT INTO c SELECT max(id) + 1 FROM c;\n" * 5 + "INSERT INTO c SELECT 1 / (max(id) - 5) FROM c;\nINSERT INTO c SELECT max(id) + 1 FROM c;\n")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    earlier = set(folder.glob("derived-*"))
    loaded = load(spark, tmp_path, *texts)
    made = len(set(folder.glob("derived-*")) - earlier)
    want = [f"({i}, {i + 1}, 'first')" for i in range(12)] + [f"({100 + i}, {i + 1}, 'copy')" for i in (5, 11)]
    assert table(loaded, "t") == sorted(want)
    assert table(loaded, "c") == [f"({i},)" for i in range(7)]
    found = reasons(loaded)
    assert found.count(("t", "duplicate key: file")) == 12 and sum("DIVIDE_BY_ZERO" in e for _, e in found) == 1
    assert made < 30  # of 43 statements


def test_statements_are_fitted_to_their_table_together(spark, tmp_path, monkeypatch):
    """Columns that are named differently are one relation; refused rows keep the names of their own statement."""
    fitted, own = [], loading._fitted
    monkeypatch.setattr(loading, "_fitted", lambda *a: fitted.append(a) or own(*a))
    texts = ["CREATE TABLE s (id INT, v TEXT);\nCREATE TABLE t (a INT, b TEXT NOT NULL, c INT);\nINSERT INTO s VALUES (0, 'x'), (1, NULL);\n"]
    texts += [f"INSERT INTO t (a, b) SELECT {i}, v AS `a \"{i}\\é` FROM s WHERE id = {i % 2};\n" for i in range(12)]
    texts += ["INSERT INTO t SELECT 1.5 AS `__path`, 'odd', 7, 8 FROM s;\nINSERT INTO t SELECT 'no number', 'y', id AS `c0` FROM s WHERE id = 0;\n"]
    loaded = load(spark, tmp_path, *texts)
    assert len(fitted) <= 4
    assert table(loaded, "t") == sorted([f"({i}, 'x', None)" for i in range(0, 12, 2)])
    sources = {r.source for r in loaded.rejects.collect()}
    assert {f'{{"{i}":{i},"a \\"{i}\\\\é":null}}' for i in range(1, 12, 2)} < sources
    assert '{"no number":"no number","y":"y","c0":0}' in sources


def test_a_walk_asks_what_a_class_is_once(spark, monkeypatch):
    """A look at a query costs a few messages to the JVM for each object in its plan, not a dozen."""
    sql = "SELECT 1, v, count(*) FROM s WHERE id + 1 > 2 GROUP BY v"
    assert guard.relations(spark, sql) == {"s"}
    asked, own = [], guard._Tree.kind
    monkeypatch.setattr(guard._Tree, "kind", lambda self, found: asked.append(found) or own(self, found))
    sent, gateway = [], spark.sparkContext._gateway._gateway_client
    send = gateway.send_command
    monkeypatch.setattr(gateway, "send_command", lambda command, *a, **k: sent.append(command) or send(command, *a, **k))
    assert guard.relations(spark, sql) == {"s"}
    calls = [c for c in sent if c.startswith("c\n")]
    assert not any("\nisInstance\n" in c for c in calls) and 0 < len(asked) and len(calls) < 6 * len(asked) + 30
