"""Line dedup against plain Python, and that it can be undone."""

import random

from askloom.llm import line_dedup
from askloom.llm.line_dedup import CuckooFilter, LineStore, line_keys

DOCS = "doc_id long, text string, row int, holder string, n_lines long, key string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS)


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def expected(held, rows):
    """``rows`` without the lines that ``held`` documents share."""
    holders = {}
    for i, t in held:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key_of(line)) >= 20:
                    holders.setdefault(key_of(line), set()).add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        own = [x for x in lines if len(holders.get(key_of(x), ())) < 3 or max(holders[key_of(x)]) == i]
        yield i, len(lines), len(lines) - len(own), "\n".join(own)


def got(store, frame):
    return sorted(str((r.id, r.n_lines, r.n_dropped, r.text)) for r in store.clean(frame).collect())


def texts(seed, n):
    random_ = random.Random(seed)
    common = ["Shared line of some length %d" % k for k in range(8)] + ["kürzer als zwanzig!", "ééééééééééééééééééé1", ""]
    rows = []
    for i in range(n):
        lines = [random_.choice(common) for _ in range(random_.randrange(0, 6))]
        lines += [f"own line of document {i} {k}" for k in range(random_.randrange(0, 3))]
        rows.append((i, "\n".join(x.upper() if random_.random() < 0.3 else f" \t{x}\r" if random_.random() < 0.3 else x for x in lines)))
    return rows


EDGES = [(None, "A line that is long enough"), (100, None), (101, ""), (102, "a line that is long enough\nA LINE THAT IS LONG ENOUGH "),
         (103, "a line that is long enough"), (104, "\x0ca line that is long enough"), (104, "a line that is long enough"),
         (105, "word " * 200_000), (106, "\u00a0a line that is long enough")]


def test_clean(spark):
    rows = texts(1, 60) + EDGES
    store = LineStore(spark)
    store.insert(docs(spark, rows).repartition(3))
    assert got(store, docs(spark, rows)) == sorted(str(x) for x in expected(rows, rows))
    store.drop()


def test_insert_and_delete_are_reversible(spark):
    first, second = texts(2, 40), [(1000 + i, t) for i, t in texts(3, 40)]
    store = LineStore(spark, shards=4)
    store.insert(docs(spark, first))
    before = got(store, docs(spark, first + second))
    store.insert(docs(spark, second))
    assert got(store, docs(spark, first + second)) == sorted(str(x) for x in expected(first + second, first + second))
    store.insert(docs(spark, second[:5]))
    store.delete(spark.createDataFrame([(i,) for i, _ in second] + [(77777,)], "doc_id long"))
    assert got(store, docs(spark, first + second)) == before
    some = [r for r in first if r[0] % 3]
    store.delete(spark.createDataFrame([(i,) for i, _ in first if i % 3 == 0], "doc_id long"))
    assert got(store, docs(spark, first)) == sorted(str(x) for x in expected(some, first))
    store.drop()


def test_filters_beyond_what_can_be_sent(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    rows = texts(5, 200) + [(1000 + i, "\n".join(f"line that three documents hold {k}" for k in range(i // 3, i // 3 + 40))) for i in range(150)] + EDGES
    store, kept = LineStore(spark, shards=2), []
    store.broadcast_bytes = 0
    own = store._routed
    monkeypatch.setattr(store, "_routed", lambda keys: kept.append((keys.count(), own(keys).count())) or own(keys))
    store.insert(docs(spark, rows[:120]))
    assert store.shards >= store.counts.count() / 2
    store.insert(docs(spark, rows[120:]))
    assert store.counts.count() <= store.shards <= 2 * store.counts.count() and store.filters.count() > 10
    assert got(store, docs(spark, rows).repartition(3)) == sorted(str(x) for x in expected(rows, rows))
    (every, some) = kept[-1]
    assert some < every - 100  # the filters spare the exact counts the lines that few hold
    store.delete(spark.createDataFrame([(i,) for i, _ in rows[:60] if i is not None], "doc_id long"))
    left = [r for r in rows if r[0] not in {i for i, _ in rows[:60]}]
    assert got(store, docs(spark, rows)) == sorted(str(x) for x in expected(left, rows))
    store.drop()


def test_empty_store_and_table(spark):
    store = LineStore(spark)
    store.insert(docs(spark, []))
    assert got(store, docs(spark, [])) == []
    assert got(store, docs(spark, EDGES)) == sorted(str(x) for x in expected([], EDGES))


def test_keys():
    assert line_keys(None) == [None]
    assert line_keys("é" * 19) == [None] and line_keys("é" * 20) != [None]
    assert line_keys("ABCDEFGHIJKLMNOPQRSTU") == line_keys("\x0b abcdefghijklmnopqrstu\t")
    assert line_keys("É" * 20) != line_keys("é" * 20)


def test_cuckoo_filter():
    random_ = random.Random(4)
    keys = [random_.randbytes(16) for _ in range(5000)]
    made = CuckooFilter.of(keys)
    assert all(k in made for k in keys)
    for k in keys[:2500]:
        made.delete(k)
    assert all(k in made for k in keys[2500:])
    others = [random_.randbytes(16) for _ in range(20000)]
    assert sum(k in made for k in others) < 20
    copy = CuckooFilter(data=made.to_bytes())
    assert all(k in copy for k in keys[2500:])
