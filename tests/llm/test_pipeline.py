"""The pipeline's stages, each on what the one before it kept, and the registered queries."""

import base64
import hashlib
import random
import tracemalloc

import __spark_entry__ as driver
import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from askloom.llm import bpe, toxicity
from askloom.llm.queries import ORACLES, QUERIES
from askloom.storage import new_folder, written
from check import compare, connect
from test_exact_and_mix import shares
from test_line_dedup import expected as without_lines
from test_near import reachable, shingles
from tokenizers import Tokenizer


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, sf_dir, key):
    problem = compare(spark, connect(sf_dir), sf_dir, QUERIES[key], ORACLES[key])
    assert problem is None, problem


def test_the_driver_has_every_query():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), name, new_folder(spark, name))
        seen[name] = (before.collect(), docs.collect())
        assert name == "bpe" or docs.columns == columns

    rows, kept = seen["toxicity"]
    source = spark.createDataFrame(rows, before.schema)
    model = toxicity.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.score_texts([r.text for r in rows], model, {})
    assert {r.doc_id for r in kept} == {r.doc_id for r, s in zip(rows, scores) if s < 0.7}

    rows, kept = seen["line_dedup"]
    pairs = [(r.doc_id, r.text) for r in rows]
    assert {r.doc_id: r.text for r in kept} == {i: t for i, _, _, t in without_lines(pairs, pairs)}
    assert all(r.n_chars == len(r.text) for r in kept)

    rows, kept = seen["minhash_near_dedup"]
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = reachable(links, sets)
    assert sorted(r.doc_id for r in kept) == sorted(i for i in sets if least[i] == i)

    rows, kept = seen["mix_sources"]
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, []).append(len(r.text.split()))
    target, taken = shares({s: sum(n) for s, n in sizes.items()}), dict.fromkeys(sizes, 0)
    for r in kept:
        taken[r.source] += len(r.text.split())
    assert all(0 <= target[s] - taken[s] < max(sizes[s]) for s in sizes)

    rows, coded = seen["bpe"]
    library = Tokenizer.from_file(bpe.default_tokenizer())
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in rows}
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in rows)
    assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in coded)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int"


def odd_documents():
    """Null and repeated ids, repeated rows, null and empty texts, near copies, shared lines."""
    rows = []
    for k in range(40):
        body = " ".join(f"w{(k // 2) * 31 + j}" for j in range(30))
        rows.append((None if k % 9 == 0 else k, f"A line that several documents hold\n{body}\nlast {k}", "en", f"s{k % 3}"))
    rows += [rows[5], rows[5], (5, "another text of this id " * 6, "en", "s0"), (100, None, None, None), (101, "", "de", None), (None, None, None, None)]
    return [(*r, 0 if r[1] is None else len(r[1]), "x", 1) for r in rows]


@pytest.mark.parametrize("rows", [odd_documents(), []])
def test_run_on_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1), (2, 0), (None, 1), (999, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name, new_folder(spark, name))
        seen[name] = docs.collect()
        assert docs.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert len(seen["line_dedup"]) == len(seen["toxicity"])
    cleaned, kept = seen["line_dedup"], seen["minhash_near_dedup"]
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in cleaned)
    ids = {r.doc_id for r in kept}
    assert all(r.doc_id in ids or any(abs(r.doc_id - i) == 1 for i in ids if i is not None) for r in cleaned)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(result) == len(seen["mix_sources"]) and bool(result) == bool(rows)
    assert sorted(str(r.doc_id) for r in result) == sorted(str(r.doc_id) for r in seen["mix_sources"])
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in seen["mix_sources"]}
    assert {r.decoded_sha256 for r in result} == texts


def test_stages_hold_little_of_the_texts_at_once(spark, tmp_path):
    made = random.Random(1)
    rows = [(i, base64.b64encode(made.randbytes(9000)).decode(), "en", "s0", 12000) for i in range(2500)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(str(tmp_path / "in")), str(tmp_path))
    mixed.coalesce(1).write.parquet(str(tmp_path / "out"))  # 30 MB in one task
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == len(rows)
    assert max(g.total_byte_size for g in groups) < 16e6
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(rows)


def test_words_are_hashed_few_at_a_time():
    made = random.Random(2)
    words = ["".join(made.choices("abcdefgh", k=made.randint(1, 14))) for _ in range(25_000)]
    tracemalloc.start()
    numbers, begins = toxicity.word_buckets(words, 1 << 18, (3, 4, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    for k in (0, 4_999, 5_000, 19_999, 20_000, 24_999):
        assert numbers[begins[k] : begins[k + 1]].tolist() == toxicity.word_buckets([words[k]], 1 << 18, (3, 4, 5))[0].tolist()
