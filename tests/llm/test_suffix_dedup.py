"""The suffix sort against every string of a hundred bytes."""

import random

import numpy as np
import pytest
from askloom.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, id string, pack long, spans int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)


def expected(rows):
    seen = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [(int(b), int(e)) for b, e in zip(edges[::2], edges[1::2])]
        yield i, len(data), spans, bytes(np.frombuffer(data, np.uint8)[~gone])


def got(spark, rows, **options):
    found = sd.without_repeats(docs(spark, rows).repartition(4), **options).collect()
    return sorted(str((r.id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept))) for r in found)


def passages(seed, n):
    random_ = random.Random(seed)
    base = ["".join(random_.choice("abcdefgh é") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(random_.randrange(0, 5)):
            kind = random_.random()
            if kind < 0.4:
                start = random_.randrange(0, 350)
                text += random_.choice(base)[start : start + random_.randrange(1, 300)]
            elif kind < 0.5:
                text += "a" * random_.randrange(1, 400)
            elif kind < 0.6:
                text += "ab" * random_.randrange(1, 200)
            else:
                text += "".join(random_.choice("abcdefgh é\0") for _ in range(random_.randrange(1, 200)))
        rows.append((i * 3 % 151, text if random_.random() > 0.05 else None))
    return rows


LONG = "".join(random.Random(8).choice("xyz ") for _ in range(30_000))


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"run_items": 7}, {"hot": 8, "run_items": 20}])
def test_passages(spark, options):
    rows = passages(1, 120) + [(None, "z" * 250), (7001, LONG), (7000, LONG[15_000:] + LONG[:99]), (7002, "s" * 99), (7003, "s" * 99)]
    assert got(spark, rows, **options) == sorted(str(x) for x in expected(rows))


def test_nothing_and_no_repeats(spark):
    assert got(spark, []) == []
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (4, LONG[:500])]
    assert got(spark, rows) == sorted(str(x) for x in expected(rows))


def test_a_text_over_several_blocks(spark):
    text = "".join(random.Random(9).choice("abcdefghij") for _ in range(sd.BLOCK + 5000))
    rows = [(1, text), (2, text[sd.BLOCK - 300 : sd.BLOCK + 300]), (3, text[sd.BLOCK + 4900 :] + text[:100])]
    assert got(spark, rows) == sorted(str(x) for x in expected(rows))


def test_merge_is_a_sort_and_knows_the_shared_prefixes():
    random_ = random.Random(2)
    for _ in range(60):
        runs = []
        for _ in range(random_.randrange(1, 9)):
            keys = sorted(bytes(random_.choice(b"ab") for _ in range(sd.KEY)) if random_.random() < 0.5
                          else b"a" * (k := random_.randrange(sd.KEY)) + b"b" * (sd.KEY - k)
                          for _ in range(random_.randrange(1, 30)))
            runs.append((keys, [0, *(sd._mismatch(a, b, 0) for a, b in zip(keys, keys[1:]))]))
        order, shared = sd.merged(runs)
        at, out = [0] * len(runs), []
        for r in order:
            out.append(runs[r][0][at[r]])
            at[r] += 1
        assert out == sorted(k for keys, _ in runs for k in keys)
        assert shared[1:] == [sd._mismatch(a, b, 0) for a, b in zip(out, out[1:])]


def test_runs_are_front_coded_and_come_back():
    random_ = np.random.default_rng(3)
    keys = np.unique(random_.integers(97, 99, (200, sd.KEY)).astype(np.uint8), axis=0)
    keys[:, :60] = 97
    keys = keys[np.argsort(keys.view(f"V{sd.KEY}").ravel())]
    n = len(keys)
    parts = [keys, random_.integers(0, 255, (n, sd.LEFT)).astype(np.uint8), np.arange(n).astype(np.uint8),
             np.arange(n), np.arange(n, dtype=np.int32), np.arange(n) * 3]
    data = sd.front_coded(*parts)
    assert all((a == b).all() for a, b in zip(sd.decoded(data)[1:], parts))
    assert len(data) < n * sd.KEY


def test_every_string_holds_an_anchor_and_equals_have_equal_ones():
    data = np.frombuffer((LONG[:3000] + "q" * 50 + LONG[1000:2000] + "a" * 300).encode(), np.uint8)
    begins = np.array([0, 3000, 3050, 4050, len(data)])
    places = sd.anchors(data, begins)
    for p in range(len(data) - 99):
        if np.searchsorted(begins, p, side="right") == np.searchsorted(begins, p + 99, side="right"):
            assert ((places >= p) & (places <= p + sd.LEFT)).any()
    inner = places[(places >= 1200) & (places < 1800)]
    assert set(inner + 2050) <= set(places.tolist())
