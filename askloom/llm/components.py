"""Connected components of a table of links, by contraction over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Staging, written
from .memory import lean

LAST = 1 << 17  # so few links, two megabytes, are followed to their ends by one task


def _priority(end: str, turn: int) -> Column:
    """First the ids themselves, since links mostly lead to the smallest of a group, then hashes."""
    return F.col(end).cast("long") if turn == 0 else F.xxhash64(F.lit(turn), end)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to (id, to): the least id that each reaches by them."""
    up: dict = {}

    def top(x):
        end = x
        while up[end] != end:
            end = up[end]
        while up[x] != end:
            up[x], x = end, up[x]
        return end

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(up.setdefault(a, a)), top(up.setdefault(b, b))
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([top(x) for x in ids], kind)], names=["id", "to"])


def components(links: DataFrame, into: Staging | None = None) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that it reaches.

    Every round gives each id the one of the least priority among its neighbours and itself, and
    links are replaced by links between these; loops and repeats are dropped. So each round
    joins only what the one before has left, expected to be three quarters of the ids at most, also
    for long chains. Once ``LAST`` links or fewer are left, of however many, a task follows them to
    their ends: the rounds to come would move next to nothing, each at the price of its shuffles. The
    rounds' answers are then followed back from the last to the first. Each
    round is written, so none is computed twice and lost executors cost one round.
    Links with a null end are ignored. An empty table has no components. The result is written
    with the tables of ``into``, else into a folder of its own.
    """
    spark, keep = links.sparkSession, into.write if into else written
    with Staging(spark, "components") as stage:
        apart = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        left = stage.write(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        rounds: list[DataFrame] = []
        while n := left.count():
            if n <= LAST:
                ends = left.select("a", "b").coalesce(1).mapInArrow(lean(_followed), f"id {left.dtypes[0][1]}, to {left.dtypes[0][1]}")
                if not rounds:
                    return keep(ends.withColumnRenamed("to", "component"), "components")
                rounds.append(stage.write(ends, "chosen"))
                break
            turn = len(rounds)
            ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = ends.groupBy("a").agg(F.min(F.struct(_priority("b", turn).alias("p"), F.col("b").alias("to"))).alias("near"))
            own = F.struct(_priority("a", turn).alias("p"), F.col("a").alias("to"))
            chosen = stage.write(near.select(F.col("a").alias("id"), F.least("near", own)["to"].alias("to")), "chosen")
            rounds.append(chosen)
            moved = (
                left.join(chosen.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
                .join(chosen.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
                .where("x <> y")
            )
            left = stage.write(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if not rounds:
            return keep(left.select(F.col("a").alias("id"), F.col("b").alias("component")), "components")
        last = rounds[-1]
        for chosen in reversed(rounds[:-1]):
            following = last.select(F.col("id").alias("to"), F.col("to").alias("end"))
            last = stage.write(
                chosen.join(following, "to", "left").select("id", F.coalesce("end", "to").alias("to")), "followed"
            )
        least = stage.write(last.groupBy("to").agg(F.min("id").alias("component")), "least")
        return keep(last.join(least, "to").select("id", "component"), "components")
