"""Keys of loaded tables: of rows that repeat one, the first in the dump's order stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Staging, written
from .joins import lookup_join

DUPLICATE = "duplicate key"


def place(prefix: str = "__") -> Column:
    """A row's place in its dump; places are compared in this order."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("path", "stmt_no", "part_no", "row_no")])


def _value(columns: tuple[str, ...]) -> Column:
    """What a row holds of a key; null if any part is null, since such rows repeat nothing."""
    parts = [F.col(f"`{c}`") for c in columns]
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def _looked_up(rows: DataFrame, keys: list[str], lookups: list[DataFrame]) -> DataFrame:
    """Rows with what each key's lookup table says of their values. Hot values are spread."""
    for key, lookup in zip(keys, lookups):
        rows = lookup_join(rows, lookup, key, "at")
    return rows


def repeated_rows(rows: DataFrame, keys: list[tuple[str, ...]], stage: Staging) -> DataFrame | None:
    """(at, reason) of the rows that repeat a key, None if there are none.

    ``rows`` have places (``__path`` and so on) and an ``__error``, if any, which takes them out of
    account. As if rows came one after the other, a row is refused if one before it that was not
    refused itself holds one of its keys. For that only rows with a value that occurs again are looked
    at. The first of them for each of its keys stay, those that meet one that stays are refused, and the
    others are judged again; a table with one key needs one such round.
    """
    names = [f"key{j}" for j in range(len(keys))]
    keyed = rows.where("__error IS NULL").select(place().alias("at"), *[_value(k).alias(n) for k, n in zip(keys, names)])
    again = []
    for name in names:
        counts = keyed.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        again.append(stage.write(counts.where("n > 1").select(name, F.lit(True).alias(f"again_{name}")), "repeated"))
    if all(found.isEmpty() for found in again):
        return None
    marked = _looked_up(keyed, names, again)
    some = F.lit(False)
    for name in names:
        some = some | F.col(f"again_{name}").isNotNull()
    repeats = [F.when(F.col(f"again_{n}").isNotNull(), F.col(n)).alias(n) for n in names]
    left = stage.write(marked.where(some).select("at", *repeats), "undecided")
    refused = []
    while not left.isEmpty():
        firsts = [
            stage.write(left.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("at").alias(f"first_{n}")), "firsts")
            for n in names
        ]
        stays = F.lit(True)
        for name in names:
            stays = stays & (F.col(name).isNull() | (F.col("at") == F.col(f"first_{name}")))
        seen = stage.write(_looked_up(left, names, firsts).select("at", *names, stays.alias("stays")), "seen")
        taken = [
            stage.write(seen.where(F.col("stays") & F.col(n).isNotNull()).select(n, F.lit(True).alias(f"taken_{n}")), "taken")
            for n in names
        ]
        met = F.lit(None).cast("string")
        for name, columns in reversed(list(zip(names, keys))):
            met = F.when(F.col(f"taken_{name}").isNotNull(), f"{DUPLICATE}: {', '.join(columns)}").otherwise(met)
        rest = _looked_up(seen.where("NOT stays").drop("stays"), names, taken).select("at", *names, met.alias("reason"))
        rest = stage.write(rest, "rest")
        refused.append(rest.where("reason IS NOT NULL").select("at", "reason"))
        left = rest.where("reason IS NULL").drop("reason")
    found = refused[0]
    for more in refused[1:]:
        found = found.unionByName(more)
    return stage.write(found, "refused")


def without_repeats(rows: DataFrame, keys: list[tuple[str, ...]], name: str, folder: str) -> DataFrame:
    """``rows`` with an ``__error`` where one repeats a key; written again only if any does.

    The source of such a row is the row itself as JSON.
    """
    if not keys:
        return rows
    spark = rows.sparkSession
    with Staging(spark, "keys") as stage:
        refused = repeated_rows(rows, keys, stage)
        if refused is None:
            return rows
        own = [c for c in rows.columns if not c.startswith("__")]
        as_text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"})
        at = rows.withColumn("__at", place())
        found = lookup_join(at, refused.withColumnRenamed("at", "__at").withColumnRenamed("reason", "__reason"), "__at", "__at")
        source = F.when(F.col("__reason").isNotNull(), as_text).otherwise(F.col("__source"))
        judged = found.withColumn("__source", source).withColumn("__error", F.coalesce("__error", "__reason"))
        return written(judged.select(*[F.col(f"`{c}`") for c in rows.columns]), name, folder)
