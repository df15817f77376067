"""A training corpus from the documents, in five stages.

``run(spark, sf_dir)`` applies them one after the other. Each stage's rows are written and
read again by the next, so a lost executor costs a part of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import askloom
from askloom.llm import bpe, line_dedup, minhash, mixing, toxicity
from askloom.llm.exact_dedup import parted
from askloom.storage import new_folder, remove_folder, swept, written

cloudpickle.register_pickle_by_value(askloom)  # executors need not have this folder on their path


#: How much of the texts an executor holds at once, at most, where a stage reads, sends and writes them.
AT_ONCE = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 250,  # rows on their way to Python
    "spark.sql.parquet.columnarReaderBatchSize": 256,  # rows read from a file
    "parquet.block.size": 8 * 1024 * 1024,  # bytes that wait to be written to a file
}


def _in_small_batches(spark: SparkSession) -> None:
    """Let tasks hold few rows at a time, for the rest of the session: rows here are whole texts, of
    which the usual thousands are tens of megabytes in the executor and in its workers alike."""
    for name, most in AT_ONCE.items():
        spark.conf.set(name, str(min(most, int(spark.conf.get(name, None) or 0) or most)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, does not find toxic."""
    _in_small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them hold, but for the largest of
    these; ``n_chars`` follows the text. A document that has lost all its lines is empty."""
    _in_small_batches(spark)
    store = line_dedup.LineStore(spark)
    store.insert(docs)
    cleaned = store.clean(docs)
    store.drop()
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(
        *[F.when(changed, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else f"row.{c}" for c in docs.columns]
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Rows with one id are one
    document; rows without an id stay. Shingles are of five words, as in all stages that are not
    told otherwise; the query of the operator alone takes four. Only the texts of documents that may
    go are moved to be matched."""
    _in_small_batches(spark)
    groups = minhash.near_groups(docs).where("id IS NOT NULL").groupBy(F.col("id").alias("key")).agg(F.max("kept").alias("kept"))
    gone = written(groups.where("NOT kept").select("key"), "near-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"))
    maybe, stay = parted(rows, F.col("key"), gone)
    return maybe.join(gone.hint("merge"), "key", "left_anti").select("row.*").unionByName(stay.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    _in_small_batches(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with digests of them and of the text decoded again."""
    _in_small_batches(spark)
    coded = bpe.encode(docs, bpe.default_tokenizer(), keep=["doc_id", "lang", "source"], output="both")
    return coded.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: A trained model has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        with swept(spark):  # the stage's own tables, once its rows are written
            docs = written(stage(spark, docs, sf_dir), name, folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return docs
