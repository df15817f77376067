"""Near-duplicates of texts and vectors against all pairs."""

import math
import random

import numpy as np
import pytest
from askloom import storage
from askloom.llm import components, cover_tree, minhash


def reachable(links, ids):
    """The smallest id that each reaches."""
    least = {i: i for i in ids}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def test_components(spark):
    random_ = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(random_.randrange(100, 300), random_.randrange(100, 300)) for _ in range(120)]
    rows = [*links, (5, 5), (None, 3), (4, None), links[0], tuple(reversed(links[1]))]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert got == reachable([p for p in links if p[0] != p[1]], ids)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("last", [0, 30, 1 << 17])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST", last)
    random_ = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(random_.randrange(100, 300), random_.randrange(100, 300)) for _ in range(120)]
    links += [(-5, 400), (400, 7), (1 << 60, 401), (401, (1 << 60) + 1)]
    frame = spark.createDataFrame([*links, (None, 3), (4, None), (9, 9)], "a long, b long").repartition(5)
    got = {r.id: r.component for r in components.components(frame).collect()}
    assert got == reachable([p for p in links if p[0] != p[1]], {x for p in links if p[0] != p[1] for x in p})


def tables_written(monkeypatch, run):
    names, own = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name, *path: names.append(name) or own(df, name, *path))
    run()
    monkeypatch.undo()
    return len(names)


def test_few_links_take_few_tables(spark, monkeypatch):
    chain = spark.createDataFrame([(k * 7919 % 3001, (k + 1) * 7919 % 3001) for k in range(3000)], "a long, b long")
    assert tables_written(monkeypatch, lambda: components.components(chain).count()) <= 2
    rows = copies(300) + [(1000 + k, " ".join(f"w{j}" for j in range(k, k + 60))) for k in range(0, 600, 3)]
    assert tables_written(monkeypatch, lambda: minhash.near_groups(docs(spark, rows), words=4, block=64).count()) <= 27


# -- Texts ----------------------------------------------------------------------------

DOCS = "doc_id long, text string, id string, n string, halves int, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOCS)


def shingles(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not own:
        return set()
    return {tuple(own)} if len(own) < words else {tuple(own[k : k + words]) for k in range(len(own) - words + 1)}


def near_copies(seed, groups, each):
    random_ = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = [f"w{random_.randrange(400)}" for _ in range(random_.randrange(20, 120))]
        for _ in range(each):
            own = list(base)
            for _ in range(random_.randrange(0, 4)):
                own[random_.randrange(len(own))] = f"n{random_.randrange(10_000)}"
            n += 1
            rows.append((n * 7 % 1009, " ".join(w.upper() if random_.random() < 0.1 else w for w in own)))
    return rows


EDGES = [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, "one"), (None, "one two"),
         (2006, "long " * 100_000), (2007, "long " * 100_000 + "x"), (2008, "é É"), (2009, "é é"), (2003, "one two"),
         (2010, "one two")]


@pytest.mark.parametrize("words,rows", [(4, near_copies(1, 12, 8) + EDGES), (5, near_copies(2, 1, 90)), (4, [])])
def test_near_groups(spark, words, rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, words))
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    least = reachable(links, sets)
    want = [(i, len(shingles(t, words)), None if i is None else least[i], i is None or least[i] == i) for i, t in rows]
    got = minhash.near_groups(docs(spark, rows).repartition(3), words=words).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_large_clusters_are_compared_in_blocks(spark):
    rows = near_copies(3, 2, 120) + [(3000 + k, " ".join(["same"] * 30 + [f"w{j}" for j in range(k)])) for k in range(1, 60)]
    one, many = (minhash.near_groups(docs(spark, rows), words=4, block=b).collect() for b in (512, 8))
    assert sorted(map(str, map(tuple, one))) == sorted(map(str, map(tuple, many)))


def test_long_texts_get_smaller_blocks(spark):
    sets = [(i, i, 50_000 + i, 1) for i in range(100)] + [(1000 + i, i, 20_000, 10 + i // 2) for i in range(400)]
    with minhash.Staging(spark, "blocks") as stage:
        members = spark.createDataFrame(sets, "id long, doc long, n long, cluster long")
        sized = minhash._sized(members, stage, 512, minhash.BLOCK_SHINGLES).selectExpr("*", "-1L AS joined")
        placed, pairs = (x.collect() for x in minhash._blocks(sized, stage, 80, 512))
    held, place, n = {}, {}, {i: n for i, _, n, _ in sets}
    for r in placed:
        place[r.id] = (r.cluster, r.band, r.part)
        held[place[r.id]] = held.get(place[r.id], 0) + n[r.id]
    assert len(place) == len(sets) and max(held.values()) < 3 << 20
    met = {frozenset([(p.cluster, p.band, p.part), (p.cluster, p.band_2, p.part_2)]) for p in pairs}
    assert all(frozenset([place[a], place[b]]) in met for a, _, _, c in sets for b, _, _, d in sets if a < b and c == d)
    rows = near_copies(4, 3, 20)
    one, many = (minhash.near_groups(docs(spark, rows), words=4, block_shingles=s).collect() for s in (None, 200))
    assert sorted(map(str, map(tuple, one))) == sorted(map(str, map(tuple, many)))


def copies(n):
    random_ = random.Random(n)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(random_.randrange(1, 3)):
            own[random_.randrange(200)] = f"n{random_.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    return rows


def test_links_do_not_grow_with_the_square(spark, monkeypatch):
    seen = []
    own = minhash.components

    def counted(links, *into):
        seen[-1].append(links.count())
        return own(links, *into)

    monkeypatch.setattr(minhash, "components", counted)
    for n in (300, 1200):
        rows = copies(n)
        seen.append([])
        got = {r.id: r.component_id for r in minhash.near_groups(docs(spark, rows), words=4, block=64).collect()}
        sets = {i: shingles(t, 4) for i, t in rows}
        if n == 300:
            links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert got == reachable(links, sets)
    (_, _, few), (_, _, many) = seen  # of buckets, of stars, of all that is verified
    assert many / 1200 < 1.2 * few / 300


# -- Vectors --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label string, id string, cell int, n_links string"


def vectors(spark, rows):
    plain = [(i, v and [None if x is None else float(x) for x in v], l) for i, v, l in rows]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in plain], VECTORS)


def clusters(seed, n, size=6, labels=2, spread=0.15):
    random_ = np.random.default_rng(seed)
    centers = random_.normal(size=(max(1, n // 8), size))
    rows = []
    for k in range(n):
        vec = centers[random_.integers(len(centers))] + random_.normal(scale=spread, size=size)
        rows.append((k * 5 % 4999, [float(x) for x in vec * random_.uniform(0.1, 10)], f"l{random_.integers(labels)}"))
    return rows


def all_pairs(rows, threshold=0.93):
    valid = [
        (i, np.array(v), l) for i, v, l in rows
        if i is not None and l is not None and v and not any(x is None or not math.isfinite(x) for x in v) and any(v)
    ]
    links = []
    for k, (i, v, l) in enumerate(valid):
        for j, u, m in valid[k + 1 :]:
            if l == m and len(u) == len(v) and float(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                links.append((i, j))
    return links


ODD = [
    (9000, None, "l0"), (9001, [], "l0"), (9002, [0.0] * 6, "l0"), (9003, [1.0, None, 0, 0, 0, 0], "l0"),
    (9004, [math.nan, 1, 0, 0, 0, 0], "l0"), (9005, [math.inf, 1, 0, 0, 0, 0], "l0"), (9006, [1.0, 0, 0, 0, 0, 0], None),
    (9007, [1.0, 2, 3, 0, 0, 0], "l0"), (9008, [1.0, 2, 3, 0, 0, 0], "l0"), (9009, [2.0, 4, 6, 0, 0, 0], "l0"),
    (9010, [1.0, 2, 3], "l0"), (9011, [1.0, 2, 3], "l0"), (9012, [1e-200, 2e-200, 3e-200, 0, 0, 0], "l0"), (9013, [1.0, 2, 3], "l1"),
    (9014, [-0.0, 0, 0, 0, 0, 5], "l1"), (9015, [0.0, 0, 0, 0, 0, 7], "l1"),
]


@pytest.mark.parametrize(
    "rows,cell",
    [(clusters(1, 300) + ODD, 1024), (clusters(2, 400, labels=1), 20), (clusters(3, 250, size=3, labels=1, spread=0.01), 16),
     (clusters(4, 200, size=64, spread=3.0), 30), ([], 10), (ODD[:3], 10)],
)
def test_embedding_groups(spark, rows, cell):
    usable = [r for r in rows if r[0] != 9012]  # its square underflows in the plain formula
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in cover_tree.embedding_groups(vectors(spark, usable), cell_size=cell).collect()}
    links = all_pairs(usable)
    least = reachable(links, [r[0] for r in usable])
    count = dict.fromkeys(got, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert got == {i: (count[i], least[i], least[i] == i) for i in count}
    assert len(got) == len(usable)


def test_tiny_vectors_and_repeated_rows(spark):
    rows = [r for r in ODD if r[0] in (9007, 9012)] + [(9007, ODD[7][1], "l0"), (None, ODD[7][1], "l0")]
    got = sorted(str(tuple(r)) for r in cover_tree.embedding_groups(vectors(spark, rows)).collect())
    assert got == sorted(["(9007, 2, 9007, True)", "(9007, 2, 9007, True)", "(9012, 2, 9007, False)", "(None, 0, None, True)"])


def test_traversal_prunes():
    """Two far clusters are told apart at the roots, and one tight cluster is counted as a block."""
    random_ = np.random.default_rng(5)
    near = cover_tree._unit(np.array([1.0, 0, 0]) + random_.normal(scale=0.001, size=(200, 3)))
    far = cover_tree._unit(np.array([0, 1.0, 0]) + random_.normal(scale=0.001, size=(200, 3)))
    a, b = cover_tree.cover_tree(near), cover_tree.cover_tree(far)
    assert cover_tree.dual_traversal(a, b, False, 0.93, near, far) == ([], [])
    blocks, pairs = cover_tree.dual_traversal(a, cover_tree.cover_tree(near), False, 0.93, near, near)
    assert sum(len(x) * len(y) for x, y in blocks) == 200 * 200 and not pairs


def test_cover_tree_covers():
    units = cover_tree._unit(np.random.default_rng(6).normal(size=(300, 4)))
    tree = cover_tree.cover_tree(units)
    for n, children in enumerate(tree.children):
        away = np.linalg.norm(units[tree.rows[n]] - units[tree.centers[n]], axis=1)
        assert away.max() <= tree.radii[n] + 1e-7
        if children:
            assert sorted(np.concatenate([tree.rows[c] for c in children])) == sorted(tree.rows[n])
            assert all(tree.radii[c] <= tree.radii[n] / 2 + 1e-7 for c in children)
