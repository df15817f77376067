"""Exact dedup: a two-pass Bloom filter lets rows with unique texts pass without a shuffle.

First pass: every task notes which filter bits its digests set once and which more
than once; the notes are merged segment by segment with counts that stop at two. A
digest all of whose bits were set twice may be repeated. Second pass: only rows with
such a digest are shuffled and compared; the others are answered where they are.

A filter without the twice-set bits of a repeated digest is impossible, so nothing is
missed; a unique digest taken for a repeated one is shuffled for nothing and comes
out as a group of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..storage import Staging, written

HASHES = 4  # bits for each digest, cut from its 32 bytes
BITS_PER_ROW = 16
SEGMENT_BITS = 1 << 20  # a segment is merged by one task
MAX_FILTER_BITS = 1 << 28  # 32 MiB: what may be broadcast, however many rows there are

_NOTES = "segment int, dense boolean, once binary, twice binary"


def filter_bits(rows: int, max_bits: int = MAX_FILTER_BITS) -> int:
    """A power of two, 16 bits for each row up to ``max_bits``.

    Beyond that the filter lets more unique rows through to the shuffle. The result
    stays the same; only the saving shrinks.
    """
    bits = SEGMENT_BITS
    while bits < BITS_PER_ROW * rows and bits < max_bits:
        bits *= 2
    return bits


def _bit_numbers(digests: pa.Array, bits: int) -> np.ndarray:
    """A row of ``HASHES`` bit numbers for each digest of 32 bytes."""
    words = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, HASHES)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def _noted(bits: int):
    """For each task and segment: the bits set, and those set more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = _bit_numbers(batch.column(0), bits).ravel()
            both = np.concatenate([numbers, more])
            weight = np.concatenate([counts, np.ones(len(more), np.int64)])
            numbers, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=weight, minlength=len(numbers)).astype(np.int64)
        edges = np.flatnonzero(np.diff(numbers // SEGMENT_BITS)) + 1
        for part, n in zip(np.split(numbers, edges), np.split(counts, edges)):
            if not len(part):
                continue
            inside = part % SEGMENT_BITS
            dense = len(inside) * 32 > SEGMENT_BITS
            pack = _bitmap if dense else (lambda x: x.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([int(part[0] // SEGMENT_BITS)], pa.int32()),
                    "dense": [dense],
                    "once": pa.array([pack(inside)], pa.binary()),
                    "twice": pa.array([pack(inside[n > 1])], pa.binary()),
                }
            )

    return run


def _bitmap(numbers: np.ndarray) -> bytes:
    flags = np.zeros(SEGMENT_BITS, bool)
    flags[numbers] = True
    return np.packbits(flags).tobytes()


def _flags(dense: bool, data: bytes) -> np.ndarray:
    if dense:
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    flags = np.zeros(SEGMENT_BITS, bool)
    flags[np.frombuffer(data, "<u4")] = True
    return flags


def _merged(at_least: int):
    """The bits of each segment that were set once, or twice, from notes sorted by segment."""

    def out(segment: int, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([segment], pa.int32()),
                "found": pa.array([np.packbits(found).tobytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            for note in batch.to_pylist():
                if note["segment"] != now:
                    if now is not None:
                        yield out(now, twice if at_least == 2 else once)
                    now, once, twice = note["segment"], np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                more = _flags(note["dense"], note["once"])
                twice |= (once & more) | _flags(note["dense"], note["twice"])
                once |= more
        if now is not None:
            yield out(now, twice if at_least == 2 else once)

    return run


def repeated_filter(digests: DataFrame, bits: int, at_least: int = 2) -> np.ndarray:
    """The bits that the digests (a binary column of 32 bytes) set twice, packed; with
    ``at_least`` 1 those they set at all, a plain Bloom filter.

    Tasks send bit numbers, or bitmaps where those are shorter, to the task of each
    segment; the driver gets ``bits`` / 8 bytes at most.
    """
    notes = digests.mapInArrow(_noted(bits), _NOTES)
    merged = (
        notes.repartition(max(1, bits // SEGMENT_BITS), "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merged(at_least), "segment int, found binary")
    )
    packed = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():
        begin = row["segment"] * SEGMENT_BITS // 8
        packed[begin : begin + SEGMENT_BITS // 8] = np.frombuffer(row["found"], np.uint8)
    return packed


def maybe_repeated(spark: SparkSession, packed: np.ndarray, digest: str | Column) -> Column:
    """False where a digest is certainly unique."""
    bits, sent = len(packed) * 8, spark.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def probe(digests: pa.Array) -> pa.Array:
        numbers, found = _bit_numbers(digests, bits), sent.value
        is_set = (found[numbers >> 3] >> (7 - (numbers & 7)).astype(np.uint8)) & 1
        return pa.array(is_set.all(axis=1))

    return probe(F.col(digest) if isinstance(digest, str) else digest)


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in ``keys`` (a column of that name), and those where it is not.

    A Bloom filter of bounded size tells them apart inside the tasks that read the rows, so only
    the first need a shuffle to be matched. Nothing in ``keys`` is among the second. The key
    is compared as text; null is a key like any other.
    """

    def name(value: Column) -> Column:
        return F.sha2(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-")), 256)

    packed = repeated_filter(keys.select(F.unhex(name(F.col("key")))), filter_bits(keys.count()), at_least=1)
    maybe = in_filter(rows.sparkSession, packed, name(key))
    return rows.where(maybe), rows.where(~maybe)


def in_filter(spark: SparkSession, packed: np.ndarray, digest: Column) -> Column:
    """Whether a filter has all bits of a digest, given in base 16, by column functions alone: no
    row with a text waits for a Python worker, and no second worker runs beside one that reads texts.
    The filter, of bounded size, is the value of a scalar subquery.
    """
    bits = len(packed) * 8
    held = spark.createDataFrame([(bytearray(packed.tobytes()),)], "packed binary").scalar()
    found = F.lit(True)
    for k in range(HASHES):
        octets = [F.substring(digest, 16 * k + 2 * b + 1, 2) for b in (3, 2, 1, 0)]  # the lowest bits come first
        number = F.conv(F.concat(*octets), 16, 10).cast("long").bitwiseAND(bits - 1)
        octet = F.conv(F.hex(F.substring(held, F.floor(number / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << (7 - i)) for i in range(8)]), (number % 8).cast("int") + 1)
        found = found & (octet.bitwiseAND(mask) != 0)
    return found


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, digest (binary), keep_id, group_size, kept.

    Texts are equal when their bytes are (null counts as empty); SHA-256 stands for
    the text. Of equal texts the row with the largest id stays. Rows that share id and
    text cannot be told apart and are kept alike. Ids are of any type that has an order. A null id is smaller than all
    others; a group of nulls alone has a null ``keep_id`` and is kept. Other columns
    of ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    with Staging(spark, "exact-dedup") as stage:
        rows = stage.write(
            docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")),
            "digests",
        )
        bits = filter_bits(rows.count(), max_filter_bits)
        packed = repeated_filter(rows.select("digest"), bits)
        path = stage.path("probed")
        rows.withColumn("maybe", maybe_repeated(spark, packed, "digest")).write.partitionBy("maybe").parquet(path)
        probed = spark.read.schema(StructType([*rows.schema.fields, StructField("maybe", BooleanType())])).parquet(path)
        maybe, alone = probed.where("maybe"), probed.where("NOT maybe")
        groups = stage.write(
            maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
            "groups",
        )
        found = maybe.join(groups, "digest").select("id", "digest", "keep_id", "group_size")
        unique = alone.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        both = unique.unionByName(found).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
        return written(both, "exact-groups")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts; the largest doc_id of each stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""
