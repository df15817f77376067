"""Calls to the language model that the caller supplies."""

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import build_prompt
from ..functions.replies import GENERATION_FAILED, parse_replies
from ..sources.predictions import PREDICTIONS

CALL = "reply string, error string, elapsed_sec double"


@dataclass(frozen=True)
class ModelSettings:
    """What the model is asked for besides the prompt."""

    temperature: float
    max_tokens: int


# Settings for generation and for review.
GENERATION = ModelSettings(temperature=0.3, max_tokens=500)
REVIEW = ModelSettings(temperature=0.2, max_tokens=300)

# Opens a client and returns the function that answers a list of prompts in order.
# It runs on the executors, once per task.
Model = Callable[[ModelSettings], Callable[[list], list]]

BATCH_BYTES = 4 * 1024 * 1024  # of prompts that are sent at once


def packed(sizes: list[int], batch_size: int, batch_bytes: int) -> Iterator[range]:
    """Runs of prompts, in order, of at most ``batch_size`` prompts and ``batch_bytes`` bytes together.

    A prompt that alone has more bytes is a run of its own.
    """
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin >= batch_size or held + size > batch_bytes):
            yield range(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield range(begin, len(sizes))


def ask_model(
    prompt: Column,
    model: Model,
    settings: ModelSettings = GENERATION,
    batch_size: int = 32,
    batch_bytes: int = BATCH_BYTES,
) -> Column:
    """struct<reply, error, elapsed_sec> for each prompt; null prompts are not sent.

    Only the prompt travels to Python. Prompts are sent in batches bounded by their number and by
    their bytes, so that a large schema in each makes batches small and not requests large. A
    batch that fails is asked again one prompt
    at a time, so that one bad prompt spoils no other row. ``elapsed_sec`` is the
    time of the call shared among the prompts of its batch.
    """

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = None

        def call(prompts):
            nonlocal ask
            if ask is None:
                ask = model(settings)
            replies = list(ask(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts got {len(replies)} replies")
            return replies

        def timed(prompts):
            begun = time.time()
            try:
                replies, errors = call(prompts), [None] * len(prompts)
            except Exception as problem:
                if len(prompts) > 1:
                    return [row for p in prompts for row in timed([p])]
                replies, errors = [None], [str(problem)]
            share = (time.time() - begun) / len(prompts)
            return [(r, e, round(share, 3)) for r, e in zip(replies, errors)]

        for batch in batches:
            rows = [(None, None, 0.0)] * len(batch)
            asked = [i for i, p in enumerate(batch) if p is not None]
            sizes = [len(batch.iloc[i].encode()) for i in asked]
            for run in packed(sizes, batch_size, batch_bytes):
                some = [asked[k] for k in run]
                for i, row in zip(some, timed([batch.iloc[i] for i in some])):
                    rows[i] = row
            yield pd.DataFrame(rows, columns=["reply", "error", "elapsed_sec"])

    # Marked nondeterministic so that the optimizer never repeats or moves a call.
    return F.pandas_udf(answer, CALL).asNondeterministic()(prompt)


def generate_batch(
    prompts: DataFrame,
    model: Model,
    settings: ModelSettings = GENERATION,
    batch_size: int = 32,
    concurrency: int | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Add the column ``call`` to rows with a ``prompt``; at most ``concurrency`` calls at once.

    The bound joins tasks rather than moving prompts between them. To have more
    tasks, repartition the questions before their schemas are attached.
    """
    if concurrency:
        prompts = prompts.coalesce(concurrency)
    return prompts.withColumn("call", ask_model(F.col("prompt"), model, settings, batch_size, batch_bytes))


def predict(
    questions: DataFrame,
    model: Model,
    dialect: str = "SQL",
    settings: ModelSettings = GENERATION,
    batch_size: int = 32,
    concurrency: int | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Prediction rows of validated questions; each question gets a row, whatever happens."""
    tried = questions.withColumn(
        "prompt",
        F.when(
            F.col("status") == "ok", build_prompt(F.col("schema_text"), F.col("question"), dialect)
        ),
    ).drop("schema_text", "has_schema_file")
    called = generate_batch(tried, model, settings, batch_size, concurrency, batch_bytes)
    parsed = parse_replies(called.withColumn("reply", F.coalesce("call.reply", F.lit(""))))
    failed = F.col("call.error").isNotNull()
    valid = F.col("status") == "ok"

    def outcome(field: str, when_failed: Column, when_invalid: Column) -> Column:
        return (
            F.when(~valid, when_invalid)
            .when(failed, when_failed)
            .otherwise(F.col(f"parsed.{field}"))
            .alias(field)
        )

    nothing = F.lit("")
    return parsed.select(
        "index",
        "db_id",
        "question",
        "gold_sql",
        outcome("predicted_sql", nothing, nothing),
        outcome("summary", nothing, nothing),
        outcome("status", F.lit("error"), F.lit("error")),
        outcome(
            "error", F.concat(F.lit(GENERATION_FAILED), F.col("call.error")), F.col("error")
        ),
        F.col("call.elapsed_sec").alias("elapsed_sec"),
    ).select(PREDICTIONS.fieldNames())
