"""A lookup join that stays balanced when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import BROADCAST_LIMIT_BYTES, small_enough, written

HOT_KEYS = 1000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    row_id: str,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, which has one row per ``key``.

    A lookup table that is measured to be small is broadcast and ``rows`` does not
    move. Otherwise both sides are shuffled, with hot keys spread by a salt.
    """
    if small_enough(lookup, broadcast_limit):
        return rows.join(F.broadcast(lookup), key, "left")
    return salted_join(rows, lookup, key, row_id)


def salted_join(
    rows: DataFrame, lookup: DataFrame, key: str, row_id: str, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Left join in which a key with more than 1/``hot_keys`` of the rows is spread.

    There are fewer than ``hot_keys`` such keys, so their list is small whatever the
    size of the tables. A hot key gets as many salts as it holds shares of that
    size, on both sides, so the work per task stays near one share; the lookup rows
    of hot keys are repeated once per salt. The salt is a hash of ``row_id``, so a
    task that is run again gives the same rows.
    """
    counts = written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    share = F.greatest(F.ceil(F.sum("n") / hot_keys), F.lit(1))
    limit = counts.agg(share.alias("share")).first()["share"] or 1
    hot = counts.where(F.col("n") > limit).select(
        F.col(key), F.ceil(F.col("n") / limit).cast("int").alias("salts")
    )
    # A null key matches nothing, so its rows stay where they are.
    lost = rows.where(F.col(key).isNull()).withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in lookup.schema if f.name != key}
    )
    rows = rows.where(F.col(key).isNotNull())
    salted = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn(
            "salt",
            F.when(F.col("salts").isNull(), 0).otherwise(
                F.pmod(F.xxhash64(row_id), F.col("salts")).cast("int")
            ),
        )
        .drop("salts")
    )
    repeated = (
        lookup.join(F.broadcast(hot), key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    joined = salted.join(repeated.hint("merge"), [key, "salt"], "left").drop("salt")
    return joined.unionByName(lost)

