"""Merkle manifests against trees built and folded by hand."""

import hashlib
import zlib

import pytest
from askloom.llm import merkle
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, rank int, path string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = [row[0], row[3], row[2], row[4], row[1]]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        now = found[-1]
        found.append([h("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return found


def path(found, at):
    out = []
    for level in found[:-1]:
        begin = at - at % 8
        out.append((level[begin:at], level[at + 1 : begin + 8]))
        at //= 8
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for at, row in enumerate(groups[g]):
            steps = path(trees[g], at) + path(top, n)
            given = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                given = (row[0], lowered(row[1]), *row[2:])
            node = leaf(given)
            for before, after in steps:
                node = h("".join(before) + node + "".join(after))
            proof = h("".join("".join(b) + "".join(a) for b, a in steps))
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(map(str, out))


def rows_of(n, langs=("en", "de", None, "")):
    made = [(k * 7 % 100_003, f"Text {k} ÄÉ" if k % 5 else f"plain {k}", langs[k * k % len(langs)], f"s{k % 3}" if k % 4 else None, k if k % 6 else None)
            for k in range(n)]
    return made


ODD = [
    (None, "Null id", "en", "s", 1), (None, "Null id", "en", "s", 1), (5, None, "en", None, None), (6, "", "en", "", 0),
    (7, "Same", "en", "s", 4), (7, "Same", "en", "s", 4), (7, "Other", "en", "s", 4), (9, "Long É" * 200_000, "xx", "s", 1), (-3, "Minus", "en", "s", 2),
]


@pytest.mark.parametrize(
    "rows",
    [rows_of(700), rows_of(70, tuple(f"l{k}" for k in range(30))) + ODD, rows_of(1), rows_of(8, ("en",)), rows_of(9, ("en",)),
     rows_of(65, (None,)), [], [ODD[0]] * 20],
)
def test_manifest(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_some_requests(spark):
    rows = rows_of(300)
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    leaves = frame.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf_digest([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    manifest = merkle.build(leaves)
    wanted = manifest.leaves.where("id % 11 = 0").select("place", "rank")
    some, every = merkle.prove(manifest, wanted).collect(), merkle.prove(manifest).collect()
    assert 0 < len(some) < len(every) == len(rows)
    assert sorted(map(str, some)) == sorted(str(r) for r in every if r.id % 11 == 0)
    folded = merkle.prove(manifest).select(merkle.folded(F.col("path"), F.col("leaf")).alias("r")).distinct().collect()
    assert [bytes(r.r) for r in folded] == [manifest.root]
    records = manifest.records.collect()
    assert all(hashlib.sha256("".join(bytes(c).hex() for c in r.children).encode()).digest() == bytes(r.digest) for r in records)
    manifest.drop()


def test_equal_nodes_are_stored_once(spark):
    frame = spark.createDataFrame([(None, b"0" * 32)] * 512, "id long, leaf binary").withColumn("group", F.lit("g"))
    manifest = merkle.build(frame)
    assert manifest.records.count() == 3 and manifest.top_depth == 0
    assert merkle.prove(manifest).count() == 512
    manifest.drop()
