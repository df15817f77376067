"""Exact dedup and mixing against plain Python."""

import hashlib

import duckdb
import numpy as np
import pytest
from askloom.llm import exact_dedup, mixing
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, id string, digest long, kept int, size string"


def docs(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows], DOCS)


def expected_groups(rows):
    found = {}
    for i, t, _ in rows:
        found.setdefault(t or "", []).append(i)
    for i, t, _ in rows:
        ids = found[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        yield i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()


CASES = [
    [],
    [(1, None, "a")],
    [(1, None, "a"), (2, "", "a"), (None, "", "a"), (3, "x", "a"), (3, "x", "a"), (None, "only", "b")],
    [(k, f"text {k % 7}" if k % 3 else f"own {k}", "a") for k in range(400)] + [(1000, "long " * 200_000, "a")] * 2,
]


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("rows", CASES)
def test_exact_groups(spark, rows):
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(4)).collect()
    assert plain((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == plain(expected_groups(rows))


def test_ids_of_other_types(spark):
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("c", None), ("d", "")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert plain((r.id, r.keep_id, r.group_size, r.kept) for r in got) == plain(
        [("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "d", 2, False), ("d", "d", 2, True)]
    )


def test_rows_parted_by_a_filter(spark):
    rows = spark.createDataFrame([(k if k % 10 else None, k) for k in range(2000)], "id long, n int")
    keys = rows.where("n % 7 = 0").select(F.col("id").alias("key")).distinct()
    maybe, never = exact_dedup.parted(rows, F.col("id"), keys)
    wanted = {r.key for r in keys.collect()}
    assert {r.id for r in never.collect()}.isdisjoint(wanted)
    assert maybe.count() + never.count() == 2000 and sum(r.id in wanted for r in maybe.collect()) > 0.9 * maybe.count()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "repeated_filter", lambda digests, bits: np.full(bits // 8, 255, np.uint8))
    rows = [(k, f"text {k // 2 if k % 5 == 0 else k}", "a") for k in range(500)]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    assert plain((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == plain(expected_groups(rows))


def test_the_filter_knows_every_repeated_digest_and_few_others(spark):
    values = spark.range(20_000).select(F.unhex(F.sha2((F.col("id") % 15_000).cast("string"), 256)).alias("digest"))
    packed = exact_dedup.repeated_filter(values.repartition(5), exact_dedup.filter_bits(20_000))
    seen = values.withColumn("maybe", exact_dedup.maybe_repeated(spark, packed, "digest")).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("maybe").alias("maybe")
    )
    assert seen.where("n > 1 AND NOT maybe").count() == 0
    assert seen.where("n = 1 AND maybe").count() < 200


def shares(sizes, weights=(5, 2, 1), limit=3):
    """Resharing as it is told: what is above the limit goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: limit * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] > limit * sizes[s]}
        if not above:
            return target
        full |= above


MIXES = [
    {"a": [3, 5, 2], "b": [100] * 40, "c": [7, 0, 1], None: [50, 60], "d": [1]},
    {"a": [1], "b": [2], "c": [1000] * 9},
    {"a": [0, 0], "b": [10] * 30},
    {"z": [4, 4, 4, 4]},
    {f"s{k}": [k + 1] * (k + 3) for k in range(12)},
]


@pytest.mark.parametrize("sizes", MIXES)
def test_mix(spark, sizes):
    rows, n = [], 0
    for source, own in sizes.items():
        for size in own:
            n += 1
            rows.append((n, " ".join(["w"] * size) if size else None, source))
    got = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert sorted(r.id for r in got) == list(range(1, n + 1))
    target = shares({s: sum(own) for s, own in sizes.items()})
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sum(sizes[r.source]) and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for source, own in sizes.items():
        assert taken[source] <= target[source] + 1e-6
        assert target[source] - taken[source] < max(own) + 1e-6
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert plain(again) == plain(got)


def test_mixed_documents_repeat_rows_with_their_columns(spark):
    rows = [(1, "a b", "x"), (2, "c " * 50, "y"), (3, "d", "y"), (None, "e f g", None), (4, None, "y")]
    frame = docs(spark, rows)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    times = {r.id: r.copies for r in mixing.mix(frame).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in times.items() if n}


def test_empty_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [])).count() == 0


def chosen(sizes, rest):
    """Ids of (id, size), in order of their hash, that are taken within ``rest`` words: up to the
    first that does not fit, and behind it each with words that fits."""
    left, cut, found = rest, False, []
    for i, size in sorted(sizes, key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()):
        cut = cut or size > left
        if size <= left and (size or not cut):
            left -= size
            found.append(i)
    return found


@pytest.mark.parametrize("few", [mixing.FEW, 0])
def test_every_document_that_still_fits_is_taken(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    own = {s: [300 if k % 9 == 0 else 0 if k % 23 == 0 else 1 + k * p % 40 for k in range(90)]
           for s, p in (("a", 7), ("b", 11), (None, 13))}
    rows = [(n * 100 + k, " ".join(["w"] * size), s) for n, (s, sizes) in enumerate(own.items()) for k, size in enumerate(sizes)]
    got = mixing.mix(docs(spark, rows).repartition(5)).collect()
    target = shares({s: sum(x) for s, x in own.items()})
    for n, (s, sizes) in enumerate(own.items()):
        epochs = int(target[s] // sum(sizes))
        more = chosen([(n * 100 + k, size) for k, size in enumerate(sizes)], target[s] - epochs * sum(sizes))
        assert sorted(r.id for r in got if r.source == s and r.copies > epochs) == sorted(more)
    assert plain(mixing.mix(docs(spark, rows).repartition(2)).collect()) == plain(got)


TIES = [(None, "w " * 10 + str(k), "a") for k in range(100)] + [(7, "w " * 9, "b")] * 60
TIES += [(k, "w " * 30, "c") for k in range(100, 120)] + [(None, "w " * k, "c") for k in (3, 3, 3, 5, 5, 40)]


def test_rows_alike_are_cut_one_by_one(spark):
    frame = docs(spark, TIES).repartition(3)
    target, taken, own = shares({"a": 1100, "b": 540, "c": 659}), {}, {"a": 11, "b": 9, "c": 3}
    got = mixing.mix(frame).collect()
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert all(0 <= target[s] - n < own[s] for s, n in taken.items() if s != "c") and taken["c"] <= target["c"]
    mixed = mixing.mixed_documents(frame).collect()
    words = dict.fromkeys(taken, 0)
    for r in mixed:
        words[r.source] += len(r.text.split())
    assert words == taken and len(mixed) == sum(r.copies for r in got)
    # none of the different texts of one id is used for another
    most = max(r.copies for r in got if r.source == "a")
    times = [sum(1 for r in mixed if r.source == "a" and r.text == t) for _, t, s in TIES if s == "a"]
    assert set(times) <= {most - 1, most}


def test_rows_alike_in_the_query_and_its_sql(spark, tmp_path):
    frame = docs(spark, TIES).select("doc_id", "text", "source")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP9_SQL})").fetchall()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
