"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, hashed to buckets; its vector is their mean, a
text's vector the mean of its words', and a softmax layer reads it. Embeddings and layer
learn together, so a misspelling never seen before shares most vectors with its word.

The model is fitted on the driver, on a bounded sample of labelled rows. Since everything
up to the softmax is linear, a bucket's vector counts only by its product with the layer:
what goes to the executors is one number per bucket.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .memory import lean

THRESHOLD = 0.7
HELD_OUT_REMAINDER, FOLDS = 1, 3

LOGS = [0.0, *(math.log(n) for n in range(1, 1000))]
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the sample: so many rows with label 1, and at most ``negatives``
    times as many with label 0."""

    max_train: int = 1500
    negatives: int = 3
    buckets: int = 1 << 18
    sizes: tuple[int, ...] = (3, 4, 5)
    dimensions: int = 8
    epochs: int = 10
    batch: int = 8
    rate: float = 1.5
    floor: float = 1.0
    sparsity: float = 2.0
    start_bias: float = -2.0
    bias_rate: float = 0.05
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Weight of each bucket and the bias: the softmax's log-odds are linear in them."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


WORDS_AT_ONCE = 5_000  # their n-grams take over 1 KB a word while they are hashed


def word_buckets(words: list[str], buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of ``<word>`` for all words, and where each word's begin
    (one more entry than words). Every word has at least one: those in it with its marks have
    three characters or more."""
    parts, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), WORDS_AT_ONCE):
        numbers, begins = _some_buckets(words[at : at + WORDS_AT_ONCE], buckets, sizes)
        parts.append(numbers)
        counts.append(np.diff(begins))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _some_buckets(words: list[str], buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[word] - np.arange(len(codes))  # characters up to the word's end
    found, owner = [], []
    value = codes
    for n in range(2, max(sizes) + 1):
        value = value[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in sizes:
            inside = left[: len(value)] >= n
            mixed = (value[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32))
            owner.append(word[: len(value)][inside])
    numbers, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    begins = np.searchsorted(owners[order], np.arange(len(words) + 1))
    return numbers[order], begins


def fit(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Embeddings and softmax from texts with labels 0 and 1, in small batches.

    Both classes weigh alike. Steps are scaled by what a bucket's gradients have been, with
    a floor so that rare buckets move little, and every step shrinks the vectors it touches by a
    share of the noise there is, so that those of words that say nothing end at zero. A word
    that a text repeats counts by the logarithm. The bias starts low and moves slowly: a text
    is clean unless its words say otherwise. Without texts of both classes the model answers 0.5.
    """
    y = np.asarray(labels, np.int64)
    flat = np.zeros(settings.buckets)
    if len(set(labels)) < 2:
        return Model(flat, 0.0, settings.sizes)
    vocabulary: dict[str, int] = {}
    bags = []
    for text in texts:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        own, counts = np.unique(np.array(ids, np.int64), return_counts=True)
        weight = 1 + np.log(counts)
        bags.append((own.astype(np.int32), (weight / max(1, weight.sum())).astype(np.float32)))
    numbers, begins = word_buckets(list(vocabulary), settings.buckets, settings.sizes)
    random = np.random.default_rng(settings.seed)
    d = settings.dimensions
    vectors = random.normal(0, 0.1, (settings.buckets, d)).astype(np.float32)
    layer, bias = random.normal(0, 0.1, (d, 2)), np.array([-settings.start_bias / 2, settings.start_bias / 2])
    seen, seen_layer, seen_bias = np.zeros(settings.buckets), 1e-8, 1e-8
    turns = 0
    importance = len(y) / (2 * np.bincount(y, minlength=2))[y]
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        order = random.permutation(len(y))
        for at in range(0, len(y), settings.batch):
            rows = order[at : at + settings.batch]
            words = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            used, back = np.unique(words, return_inverse=True)
            sizes = begins[used + 1] - begins[used]
            firsts = np.cumsum(sizes) - sizes
            places = np.arange(sizes.sum()) + np.repeat(begins[used] - firsts, sizes)
            grams = numbers[places]
            hidden = np.zeros((len(rows), d))
            if len(used):
                word_vectors = np.add.reduceat(vectors[grams], firsts, axis=0) / sizes[:, None]
                np.add.at(hidden, row, word_vectors[back] * share[:, None])
            odds = hidden @ layer + bias
            odds -= odds.max(axis=1, keepdims=True)
            chance = np.exp(odds)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(rows)), y[rows]] -= 1
            error = chance * importance[rows][:, None] / len(rows)
            layer_step, bias_step = hidden.T @ error, error.sum(axis=0)
            to_hidden = error @ layer.T
            seen_layer += float((layer_step**2).mean())
            seen_bias += float((bias_step**2).mean())
            layer -= rate * layer_step / np.sqrt(seen_layer)
            bias -= settings.bias_rate * rate * bias_step / np.sqrt(seen_bias)
            if len(used):
                to_words = np.zeros((len(used), d))
                np.add.at(to_words, back, to_hidden[row] * share[:, None])
                to_grams = np.repeat(to_words / sizes[:, None], sizes, axis=0)
                touched, where = np.unique(grams, return_inverse=True)
                step = np.stack([np.bincount(where, to_grams[:, k], len(touched)) for k in range(d)], axis=1)
                seen[touched] += (step**2).mean(axis=1)
                scale = np.sqrt(seen[touched] + settings.floor * seen.mean())
                moved = vectors[touched] - rate * step / scale[:, None]
                turns += 1
                shrink = rate * settings.sparsity * np.sqrt(seen.mean() / turns) / scale
                norm = np.sqrt((moved**2).sum(axis=1)) + 1e-12
                vectors[touched] = moved * np.maximum(0, 1 - shrink / norm)[:, None]
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), settings.sizes)


def _mean(words: list[str], known: dict[str, float]) -> float:
    counts = Counter(words)
    weights = [1 + LOGS[n] if n < len(LOGS) else 1 + math.log(n) for n in counts.values()]
    return sum(map(operator.mul, weights, map(known.__getitem__, counts))) / max(1, sum(weights))


def score_texts(texts: list[str | None], model: Model, known: dict[str, float]) -> np.ndarray:
    """Probabilities of label 1. ``known`` keeps words' weights from call to call."""
    split = [words_of(t) for t in texts]
    new = list({w for words in split for w in words if w not in known})
    for at in range(0, len(new), WORDS_AT_ONCE):
        some = new[at : at + WORDS_AT_ONCE]
        numbers, begins = word_buckets(some, len(model.weights), model.sizes)
        means = np.add.reduceat(model.weights[numbers], begins[:-1]) / np.diff(begins)
        known.update(zip(some, means.tolist()))
    odds = np.array([_mean(words, known) for words in split]) + model.bias
    return 1 / (1 + np.exp(-_tempered(odds)))


SURE = 10.0  # log-odds beyond which only their logarithm counts


def _tempered(odds: np.ndarray) -> np.ndarray:
    """Log-odds in the same order, but none so large that a score is exactly 0 or 1."""
    beyond = np.maximum(np.abs(odds) - SURE, 0)
    return np.clip(odds, -SURE, SURE) + np.sign(odds) * np.log1p(beyond)


KNOWN_WORDS = 100_000  # kept per task; a cache, emptied when full
ROWS_AT_ONCE = 512  # texts held as Python values


def is_held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: by a checksum of the id; a null id is held out too."""
    fold = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_REMAINDER, F.lit(True))


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model from the labelled rows that are not held out.

    Of each class the rows with the smallest hash of their id are taken, as many as
    ``settings`` allow, with their whole texts. Ids with several labels count as 1 if one of them is, and of ids with
    several texts the one with the smallest hash is taken; null labels, and ids without a text, are left out.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
        .where(~is_held_out("id") & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    rank = F.xxhash64(F.col("id").cast("string"), F.lit(settings.seed))
    chosen = None
    for label in (0, 1):
        few = known.where(F.col("label") == label).orderBy(rank, "id").limit(settings.max_train * (settings.negatives if label == 0 else 1))
        chosen = few if chosen is None else chosen.unionByName(few)
    chosen = chosen.cache()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # at most (1 + negatives) * max_train ids, so their broadcast is bounded
    own = texts.join(F.broadcast(chosen), "id").where("text IS NOT NULL")
    found = own.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).collect()
    chosen.unpersist()
    rows = sorted(((r["id"], r["text"], int(r["label"])) for r in found))
    del found
    return fit([r[1] for r in rows], [r[2] for r in rows], settings)


def with_scores(
    docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Rows (row, score): ``row`` holds the columns ``keep`` of the input (all by default),
    so none can clash with the score.

    Every word of every text counts. Texts without words, and nulls, get the score of the
    bias alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        own = Model(*sent.value)
        for batch in batches:
            texts = batch.column("row").field(text_col) if keep is None else batch.column("text")
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                scores = score_texts(texts.slice(at, ROWS_AT_ONCE).to_pylist(), own, known)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                rows = batch.column("row").slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([rows, pa.array(scores)], names=["row", "score"])

    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    # the text travels once: inside its row, if that is kept whole
    apart = [] if keep is None else [F.col(f"`{text_col}`").alias("text")]
    rows = docs.select(kept.alias("row"), *apart)
    return rows.mapInArrow(lean(run), StructType([rows.schema["row"]]).add("score", DoubleType()))


def op2_toxicity(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Every document's toxicity, by a model that never saw the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings)
    scored = with_scores(docs, model, keep=["doc_id"])
    return scored.select(
        "row.doc_id",
        is_held_out("row`.`doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
