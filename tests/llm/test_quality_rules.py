"""Quality rules against plain loops, and robust estimates against numpy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from askloom.llm import quality_rules as q

DOCS = "doc_id long, text string, lang string, source string, words string, d2 int, kept string, `group` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    starts = defaultdict(list)
    for i in range(len(words) - 7):
        starts[tuple(words[i : i + 8])].append(i)
    covered = {p for found in starts.values() if len(found) > 1 for i in found for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def texts(seed, n):
    random_ = random.Random(seed)
    words = ["a", "bb", "Ärger", "日本語", "c#", "<d>", " ", "e f"]
    for _ in range(n):
        part = [random_.choice(words) for _ in range(random_.randrange(1, 30))]
        text = random_.choice([" ", "\n", "\t \r", " "]).join(part * random_.randrange(1, 5))
        yield random_.choice(["", "\n", " x\n"]) + text + random_.choice(["", "\n" + text, "\n\n \n"])


ODD = [None, "", " \t\n", "one", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i", "x " * 100_000, "same line\n" * 3000,
       "|" * 1000, "w" * 300_000, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"]


def test_statistics(spark):
    given = ODD + list(texts(1, 300))
    rows = docs(spark, [(i, t, "en", "s") for i, t in enumerate(given)])
    found = q.text_statistics(rows["text"])
    got = rows.select("doc_id", *[c.alias(n) for n, c in found.items()]).select("doc_id", "words.*", "lines.*", "n_symbols").collect()
    for r in got:
        assert {k: r[k] for k in statistics("")} == statistics(given[r.doc_id]), given[r.doc_id]


def prose(random_, n, length=5, junk=""):
    words = ["".join(random_.choice("abcdefghij") for _ in range(max(1, round(random_.gauss(length, 1))))) for _ in range(n)]
    return " ".join(w + junk for w in words)


def corpus(seed, n):
    random_ = random.Random(seed)
    for k in range(n):
        lang, source = random_.choice(["en", "en", "de", None]), random_.choice(["s0", "s0", "s0", "s1", None])
        kind = "junk" if k % 9 == 0 else "short" if k % 13 == 0 else "plain"
        size = 5 if kind == "short" else random_.randrange(40, 300)
        yield k, prose(random_, size, 6 if lang == "de" else 5, "%%%" if kind == "junk" else ""), lang, source, kind


def groups(rows):
    """The rule by which documents are put together, for those that pass the base rules."""
    by_source, by_lang = Counter((r[2], r[3]) for r in rows), Counter()
    for r in rows:
        if by_source[r[2], r[3]] < q.MIN_GROUP:
            by_lang[r[2]] += 1
    for r in rows:
        if by_source[r[2], r[3]] >= q.MIN_GROUP:
            yield ("source", r[2], r[3])
        else:
            yield ("lang", r[2]) if by_lang[r[2]] >= q.MIN_GROUP else ("all",)


def distances(x):
    """Squared distances by minimum covariance determinant, from the medians."""
    floors = np.array(q.FLOORS) * q.SCALE
    middle = np.sort(x, axis=0)[(len(x) - 1) // 2]
    centre, factor = middle.astype(float), np.diag(floors)
    for step in range(q.STEPS + 1):
        z = np.linalg.solve(factor, (x - centre).T)
        d2 = (z**2).sum(axis=0)
        if step == q.STEPS:
            return d2
        bins = np.minimum(np.floor(np.sqrt(d2) * q.BINS), q.BINS * q.FAR)
        near = [2 * (bins < b).sum() < len(x) + q.DIMS + 1 for b in bins]
        chosen = x[near]
        centre = chosen.mean(axis=0)
        factor = np.linalg.cholesky(np.cov(chosen.T, bias=True) * q.HALF_FACTOR + np.diag(floors**2))


@pytest.mark.parametrize("seed,n", [(1, 900), (2, 40), (3, 150)])
def test_verdicts(spark, seed, n):
    rows = list(corpus(seed, n))
    got = {r.id: r for r in q.quality_rules(docs(spark, [r[:4] for r in rows]).repartition(3)).collect()}
    assert len(got) == n
    stats = {r[0]: statistics(r[1]) for r in rows}
    passed = [r for r in rows if stats[r[0]]["n_words"] >= 20 and 100 * stats[r[0]]["n_repeat_words"] <= 30 * stats[r[0]]["n_words"]]
    assert all(got[r[0]].base_failed == (r not in passed) for r in rows)
    members = defaultdict(list)
    for r, group in zip(passed, groups(passed)):
        members[group].append(r)
    for own in members.values():
        if len(own) < q.MIN_GROUP:
            assert all(got[r[0]].kept and got[r[0]].d2 is None for r in own)
            continue
        x = []
        for r in own:
            s = stats[r[0]]
            shares = [s["word_chars"] / s["n_words"], s["n_symbols"] / s["word_chars"], s["n_dup_lines"] / s["n_lines"], s["n_repeat_words"] / s["n_words"]]
            x.append([math.floor(math.sqrt(v) * q.SCALE + 0.5) for v in shares])
        for r, d2 in zip(own, distances(np.array(x))):
            assert got[r[0]].d2 == pytest.approx(d2, rel=1e-6, abs=1e-9)
            assert got[r[0]].kept == (d2 <= q.CUT)
    if n == 900:
        kinds = {r[0]: r[4] for r in rows}
        assert not any(got[i].kept for i, kind in kinds.items() if kind == "junk")
        clean = [got[i].kept for i, kind in kinds.items() if kind == "plain"]
        assert sum(clean) > 0.98 * len(clean)


def test_odd_rows(spark):
    rows = [(None, "a b", None, None), (1, None, "en", "s"), (1, None, "en", "s"), (2, prose(random.Random(1), 30), "en", "s")]
    got = sorted(str((r.id, r.n_words, r.base_failed, r.kept)) for r in q.quality_rules(docs(spark, rows)).collect())
    assert got == sorted(["(None, 2, True, False)", "(1, 0, True, False)", "(1, 0, True, False)", "(2, 30, False, True)"])
    assert q.quality_rules(docs(spark, [])).count() == 0


def test_equal_vectors_have_no_spread(spark):
    rows = [(k, "aaaa bbbb " * 3 + " ".join(f"{chr(97 + k % 26)}{j:03}" for j in range(40)), "en", "s") for k in range(80)]
    assert all(r.kept and r.d2 == 0 for r in q.quality_rules(docs(spark, rows)).collect())


def test_no_python_runs_on_the_executors(spark, sf_dir, monkeypatch):
    plans = []
    own = q.written
    monkeypatch.setattr(q, "written", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or own(df, *a))
    q.op13_quality_rules(spark, sf_dir)
    assert plans and not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas"))
