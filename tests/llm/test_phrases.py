"""Phrases against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from askloom.llm import phrases
from askloom.llm.memory import small_batches

DOCS = "doc_id long, text string, lang string, word string, n int, block string"


def docs(spark, rows):
    return spark.createDataFrame([(i, text, lang, "x", 1, "y") for i, (text, lang) in enumerate(rows)], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    """Counts of all runs of up to four words, by language."""
    found = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    found[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    return found


def expected(rows, least=30, top=2000):
    out = []
    for lang, counts in counted(rows).items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in candidates.items():
            inside = [
                c for q, c in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * c >= 80 * a for c in inside):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts(seed, n, words=12):
    random_ = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "é", "Der", "the end", "日本", "a"]
    return [
        ("".join(random_.choice(vocabulary) + random_.choice([" ", "  ", "\t", " ", " ", ", ", "\n", ".", "!?"]) for _ in range(random_.randrange(60))),
         random_.choice(["en", "en", "en", "de", None, ""]))
        for _ in range(n)
    ]


ODD = [
    (None, "en"), ("", "en"), (" \t\n.,", None), ("one", "de"), ("New York City hall " * 400, "en"), ("x " * 5000, "fr"),
    ("long" * 50_000 + " end", "fr"), ("A b. " * 100, None), ("a B\v" * 100, "und"), ("same same", "en"), ("same same", "en"),
]


@pytest.mark.parametrize(
    "rows,least,sizes",
    [(texts(1, 300) + ODD, 30, {}), (texts(2, 400, 40), 5, {"block_bytes": 900, "chunk_bytes": 300, "range_words": 50}),
     (texts(3, 300, 5), 30, {"block_bytes": 4000, "chunk_bytes": 100, "range_words": 1000}), ([], 30, {}), (ODD[:3], 1, {})],
)
def test_phrases(spark, rows, least, sizes):
    got = phrases.phrase_table(docs(spark, rows).repartition(3), min_count=least, **sizes).collect()
    assert sorted(map(tuple, got)) == expected(rows, least)


def test_the_first_of_each_language(spark):
    rows = texts(4, 300, 6)
    got = phrases.phrase_table(docs(spark, rows), top=7, min_count=3).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 7)


def test_hashes_that_collide_change_nothing(monkeypatch):
    rows = texts(5, 200)

    def few(self):
        for n in range(1, phrases.MAX_WORDS + 1):
            yield n, np.full(max(0, len(self.ids) - n + 1), 3, np.uint64)

    words = phrases._Words("en", " ".join(t or "" for t, _ in rows).encode())
    listed = np.array([3], np.uint64)
    monkeypatch.setattr(phrases._Words, "hashes", few)
    counts = Counter()
    for prefixes, nexts, n in phrases.stripes_of(words, listed):
        counts.update({(p, w): int(k) for p, w, k in zip(prefixes, nexts, n)})
    plain = Counter()
    text = " ".join(t or "" for t, _ in rows)
    for piece in text.split("\n"):
        run = re.findall(r"[^\x20]+", piece)
        for k in range(1, 5):
            for i in range(len(run) - k + 1):
                plain[" ".join(run[i : i + k - 1]), run[i + k - 1]] += 1
    assert {k: v for k, v in counts.items() if k[1] is not None} == plain


def test_stripes_hold_totals_and_extensions(spark):
    rows = texts(6, 200)
    found = defaultdict(Counter)
    merged = Counter()
    for r in phrases.stripes(docs(spark, rows), min_count=10, block_bytes=2000, chunk_bytes=500).collect():
        merged[r.lang, r.prefix, r.word] += r.n
        found[r.lang][r.prefix] += r.n
    for lang, counts in counted(rows).items():
        for p, c in counts.items():
            if c >= 10 and len(p) < 4:
                assert found[lang][" ".join(p)] == c
            if c >= 10:
                assert merged[lang, " ".join(p[:-1]), p[-1]] == c
        assert found[lang][""] == sum(c for p, c in counts.items() if len(p) == 1)


def test_batches_stay_small(monkeypatch):
    """However much of a block is frequent, its messages, lists and stripes come out a few at a time."""
    monkeypatch.setattr(phrases, "BATCH_ROWS", 50, raising=False)
    monkeypatch.setattr(phrases, "BATCH_BYTES", 500, raising=False)
    data = b"".join(b"a%d b%d c%d d%d\n" % (i, i % 90, i % 7, i) for i in range(2000))

    def batch(block, lang, data):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang], pa.string()), pa.array([data], pa.binary())], ["block", "lang", "data"])

    sent = list(phrases._messages(6)(iter([batch(1, "en", data)])))
    lists = list(phrases._frequent(1)(iter([b for b in sent])))
    rows = [batch(block, None, d) for b in lists for block, d in zip(b["block"].to_pylist(), b["data"].to_pylist())]
    stripes = list(phrases._entries(iter([*rows, batch(1, "en", data)])))
    assert len(sent) > 9 and max(sum(len(d) for d in b["data"].to_pylist()[:-1]) for b in sent) <= 500
    assert max(b.num_rows for b in stripes) == 50
    counts = {(r["prefix"], r["word"]): r["n"] for b in stripes for r in b.to_pylist()}
    assert counts["", "c3"] == 2000 // 7 + 1 and counts["a5 b5 c5", "d5"] == 1
    assert len(counts) == sum(b.num_rows for b in stripes)


def test_rows_reach_python_in_small_batches(spark):
    """Chunks of texts are long, and a whole partition of them is not one batch."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    long = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 200000) AS x")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    with small_batches(spark):
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 5 << 20
    assert spark.conf.get(setting) == before
    assert phrases.CHUNK_BYTES <= 1 << 19  # two copies of a row are below what the JVM has to place by itself


def test_packed_numbers_come_back():
    random_ = np.random.default_rng(1)
    for n in (0, 1, 5000):
        first = np.sort(random_.integers(0, 1 << 48, n, np.uint64))
        second = random_.integers(0, 1 << 32, n, np.uint64)
        a, b = phrases._unpacked(phrases._packed(first, second), 1)
        assert (a == first).all() and (b == second).all()


def test_scores_beyond_64_bits(spark):
    a = 1 << 61
    rows = [("en", "p", "q", a), ("en", "p", None, a), ("en", "q", None, a + a // 2), ("en", "", "p", 7), ("en", "", "q", 8)]
    found = spark.createDataFrame(rows, "lang string, prefix string, word string, n long")
    with phrases.Staging(spark, "scores") as stage:
        got = phrases.collocations(found, stage).collect()
    assert [tuple(r) for r in got] == [("en", "p q", a, 2 * a, a + a // 2, 15, 571_428)]
