"""BPE against the tokenizer library, and the toxicity model on held-out rows."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from askloom.llm import bpe, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, row string, ids int, n_tokens string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


ALPHABETS = [
    [" ", "  ", "\n", "'", "'s", "'ll", "l", "re", "'re", "the", "ing", "1", "23", "!", "é", "日本", "\u0085", "😀", "\t", "'v", "e",
     "<|endoftext|>", "xxxxxxx"],
    ["a", "b", "ab", "the"], ["'", "l", "s", "re", "v", "e"], [" ", "\n", "a"], ["1", "2", "'"], ["a"], ["日", "本", "é"],
]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_joined_pieces_are_the_tokens_of_the_whole(codec, library, alphabet):
    random_ = random.Random(len(alphabet))
    for _ in range(400):
        text = "".join(random_.choice(alphabet) for _ in range(random_.randrange(0, 100)))
        piece, ids = random_.randrange(1, 40), []
        for section, special in codec.sections(text):
            cut = [section[i : i + piece] for i in range(0, len(section), piece)]
            nodes = [bpe.Node(c, codec.encode_plain(c).tolist()) for c in cut]
            ids += [codec.special[section]] if special else bpe.tree_joined(codec, nodes, random_.randrange(1, 20)).ids
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


TEXTS = [
    None, "", " ", "Hello's  world", "a" * 5000, "word " * 4000, "x1!" * 3000, "日本語" * 2000, "<|endoftext|>" * 300,
    "mixed <|endoftext|>\n\n  text " * 200, " " * 4000, "ab" * 3000 + " " + "cd" * 3000, "word " * 4000,
]


@pytest.mark.parametrize("output", ["ids", "both"])
def test_encode_and_decode_tables(spark, library, output):
    frame = docs(spark, [*enumerate(TEXTS), (None, "no id"), (0, "again")])
    coded = bpe.encode(frame, PATH, piece_chars=700, window=16, output=output)
    back = {r.row.doc_id: r for r in bpe.decode(coded, PATH, keep=("row", "ids")).where("row.doc_id > 0").collect()}
    for n, text in list(enumerate(TEXTS))[1:]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert back[n].ids == ids and back[n].decoded == library.decode(ids, skip_special_tokens=False)
        assert back[n].row.ids == 1 and back[n].row.n_tokens == "y"
    assert coded.count() == len(TEXTS) + 2


def test_the_text_of_a_long_document_moves_once(spark, library, tmp_path):
    random_ = random.Random(5)
    texts = [base64.b64encode(random_.randbytes(90_000)).decode() for _ in range(20)]  # nothing compresses these much
    frame = docs(spark, [*enumerate(texts), *((100 + n, t) for n, t in enumerate(texts))]).coalesce(1)
    frame.write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {str(f.getName()): f.length() for d in disk.localDirs() for sub in d.listFiles() or () for f in sub.listFiles() or ()
                if str(f.getName()).endswith(".data")}

    before = shuffled()
    got = {r.row.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode(rows, PATH, keep=["doc_id"], output="digests").collect()}
    moved = sum(size for name, size in shuffled().items() if name not in before)
    for n, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[n] == got[100 + n] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    tokens = sum(got[n][0] for n in range(len(texts)))
    assert moved < 1.2 * (sum(map(len, texts)) + 2 * tokens)  # the characters, and a token's two bytes


def test_encode_nothing(spark):
    assert bpe.encode(docs(spark, []), PATH).count() == 0


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


# -- Toxicity -------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.1")
    found = toxicity.op2_toxicity(spark, where, toxicity.Settings(max_train=800, epochs=8))
    labels = spark.read.parquet(f"{where}/labels.parquet")
    rows = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.toxic for r in out) / len(out)
    caught = sum(r.predicted for r in out if r.toxic) / sum(r.toxic for r in out)
    alarms = sum(r.predicted for r in out if not r.toxic) / sum(not r.toxic for r in out)
    assert right > 0.97 and caught > 0.85 and alarms < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.fixture(scope="module")
def model():
    random_ = random.Random(9)
    words = ["".join(random_.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(random_.choice(words) for _ in range(40)) for _ in range(300)]
    labels = [k % 3 == 0 for k in range(300)]
    texts = [f"{t} wretched {t} wretched" if y else t for t, y in zip(texts, labels)]
    return toxicity.fit(texts, [int(y) for y in labels], toxicity.Settings(buckets=1 << 14))


def test_misspellings_share_the_subwords(model):
    known: dict = {}
    clean, toxic, misspelt = toxicity.score_texts(["abcde fghab", "wretched abcde", "wretchedd abcde"], model, known)
    assert toxic > misspelt > clean and toxic > 0.7


def plain_buckets(word, buckets, sizes):
    """The n-grams of ``<word>`` hashed one by one, as many as there are."""
    marked, found = [ord(c) for c in f"<{word}>"], []
    for n in sizes:
        for i in range(len(marked) - n + 1):
            value = marked[i]
            for code in marked[i + 1 : i + n]:
                value = (value * 0x100000001B3 + code) % 2**64
            found.append(((value + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % buckets)
    return found


def plain_score(text, model):
    """The score of a text by loops over its words and their n-grams."""
    words = re.findall(r"\w+", (text or "").lower())
    total, weights = 0.0, 0.0
    for word in set(words):
        own = [model.weights[b] for b in plain_buckets(word, len(model.weights), model.sizes)]
        weight = 1 + math.log(words.count(word))
        total, weights = total + weight * sum(own) / len(own), weights + weight
    odds = total / max(1, weights) + model.bias
    if abs(odds) > 10:
        odds = math.copysign(10 + math.log(1 + abs(odds) - 10), odds)
    return 1 / (1 + math.exp(-odds))


def test_scores_against_plain_loops(model):
    texts = [None, "", "!", "a", "wretched abcde", "Wretched ÄÖ É日本 wretched", "abcde " * 30 + "fgh", "x" * 300, "a_b 12 c'd"]
    got = toxicity.score_texts(texts, model, {})
    assert got.tolist() == pytest.approx([plain_score(t, model) for t in texts], rel=1e-9)
    assert len(set(got.round(15))) > 5 and all(0 < s < 1 for s in got)


def test_a_training_step_against_plain_loops():
    """One step over two texts, each gradient by hand."""
    texts, labels = ["ab cd cd", "ef"], [1, 0]
    s = toxicity.Settings(buckets=64, sizes=(3,), dimensions=2, epochs=1, batch=2, rate=1.0, floor=1.0, sparsity=0.0, start_bias=-4.0)
    got = toxicity.fit(texts, labels, s)
    random_ = np.random.default_rng(s.seed)
    vectors = random_.normal(0, 0.1, (64, 2)).astype(np.float32)
    layer, bias = random_.normal(0, 0.1, (2, 2)), [2.0, -2.0]
    grads, to_layer, to_bias = np.zeros((64, 2)), np.zeros((2, 2)), np.zeros(2)
    for text, y in zip(texts, labels):
        words = text.split()
        weight = {w: 1 + math.log(words.count(w)) for w in words}
        share = {w: np.float32(v / sum(weight.values())) for w, v in weight.items()}
        means = {w: np.mean([vectors[b] for b in plain_buckets(w, 64, (3,))], axis=0) for w in weight}
        hidden = sum(share[w] * means[w] for w in weight)
        odds = hidden @ layer + bias
        error = (np.exp(odds) / np.exp(odds).sum() - np.eye(2)[y]) / 2  # two texts, equal weights
        to_layer += np.outer(hidden, error)
        to_bias += error
        for w in weight:
            own = plain_buckets(w, 64, (3,))
            for b in own:
                grads[b] += share[w] * (error @ layer.T) / len(own)
    seen = (grads**2).mean(axis=1)
    touched = grads.any(axis=1)
    moved = vectors.astype(float)
    moved[touched] -= grads[touched] / np.sqrt(seen[touched] + seen.mean())[:, None]
    layer = layer - to_layer / np.sqrt(1e-8 + (to_layer**2).mean())
    bias = np.array(bias) - 0.05 * to_bias / np.sqrt(1e-8 + (to_bias**2).mean())
    assert got.weights == pytest.approx(moved @ (layer[:, 1] - layer[:, 0]), abs=1e-5)
    assert got.bias == pytest.approx(bias[1] - bias[0])


def test_scores_of_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "wretched " * 100_000), (None, "wretched"), (2, "wretched")]
    got = [(r.row.doc_id, r.score) for r in toxicity.with_scores(docs(spark, rows), model).collect()]
    assert len(got) == 6 and len({s for i, s in got[:3]}) == 1 and got[0][1] < 0.5
    assert got[3][1] > 0.7 and got[4] == (None, got[5][1])
    assert toxicity.with_scores(docs(spark, []), model).count() == 0


def test_training_uses_one_text_of_a_repeated_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, settings: seen.append(list(zip(texts, labels))))
    rows = [(i, f"text {i}") for i in range(60)] + [(2, None)] + [(i, f"other {k}") for i in (0, 1, 7, 8) for k in range(50)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for parts in (1, 5):
        toxicity.train(docs(spark, rows).repartition(parts), marks)
    own = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {0, 1, 7, 8} <= own and len(seen[0]) == len(own) and seen[0] == seen[1]
    assert {(f"text {i}", i % 2) for i in own - {0, 1, 7, 8}} <= set(seen[0])


def test_training_uses_no_held_out_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, settings: seen.extend(zip(texts, labels)))
    frame = docs(spark, [(i, f"text {i}") for i in range(60)] + [(60, None), (None, "no id")])
    marks = [(i, i % 2) for i in range(61)] + [(3, 0), (5, None), (None, 1), (999, 1), (4, 1)]
    toxicity.train(frame, spark.createDataFrame(marks, "doc_id long, toxic int"))
    want = {(f"text {i}", 1 if i == 4 else i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(seen) == want and len(seen) == len(want)
    seen.clear()
    toxicity.train(frame, spark.createDataFrame(marks, "doc_id long, toxic int"), toxicity.Settings(max_train=2, negatives=1))
    assert len(seen) == 4


def test_one_class_gives_no_opinion():
    model = toxicity.fit(["a b", None], [0, 0])
    assert toxicity.score_texts(["a"], model, {}).tolist() == [0.5]
    assert toxicity.score_texts(["a"], toxicity.fit([], []), {}).tolist() == [0.5]


def test_held_out_of_null(spark):
    frame = spark.createDataFrame([(None,), (1,)], "doc_id long")
    got = frame.select(toxicity.is_held_out().alias("h"), F.col("doc_id")).collect()
    assert {r.doc_id: r.h for r in got} == {None: True, 1: zlib.crc32(b"1") % 3 == 1}
