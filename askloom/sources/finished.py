"""Which questions are finished, as bitmaps beside the prediction table.

A resumed run or a micro-batch needs to know which of its own questions are done, not all rows that
were ever written. So each writer of the table keeps, in a folder beside it, a bitmap of 32,768 indices
for every segment of indices that it has touched, one small file each: one bitmap for all that were
tried and one for those without an error. A new version of a segment's file holds what the one before it
held, so a reader takes the newest of each writer, for the segments it asks about and no others.

What a writer has appended without coming to its bitmaps, and folders older than these, are read from
the predictions themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove_folder

SUFFIX = ".finished"  # of the folder beside the table's
BITMAPS = "tried binary, fine binary, segment long"
MOST_SEGMENTS = 4096  # beyond that a reader asks for all; the answer is the same


def _home(table: str) -> str:
    return table.rstrip("/") + SUFFIX


def _listed(spark: SparkSession, pattern: str) -> list[JavaObject]:
    """Files and folders that match, none if the place does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [] if found is None else list(found)


def _name(entry: JavaObject) -> str:
    return entry.getPath().getName()


def _versions(spark: SparkSession, table: str, writer: str, segments: Iterable[int] | None) -> dict[tuple[str, int], list[int]]:
    """The batches of each writer's segment, ascending."""
    some = "*" if segments is None else "{" + ",".join(map(str, segments)) + "}"
    found: dict[tuple[str, int], list[int]] = {}
    for entry in _listed(spark, f"{_home(table)}/{writer}/segment={some}/batch=*"):
        path = entry.getPath()
        key = (path.getParent().getParent().getName(), int(path.getParent().getName().split("=")[1]))
        found.setdefault(key, []).append(int(path.getName().split("=")[1]))
    return {key: sorted(batches) for key, batches in found.items()}


def _newest(
    spark: SparkSession, table: str, segments: list[int] | None, writer: str = "*", below: int | None = None
) -> list[str]:
    """The folders that hold the newest version of each segment, of batches before ``below``."""
    folders = []
    for (name, segment), batches in _versions(spark, table, writer, segments).items():
        usable = [b for b in batches if below is None or b < below]
        if usable:
            folders.append(f"{_home(table)}/{name}/segment={segment}/batch={usable[-1]}")
    return folders


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], BITMAPS)
    rows = spark.read.schema("tried binary, fine binary").parquet(*folders)
    segment = F.regexp_extract(F.col("_metadata.file_path"), r"/segment=(-?\d+)/", 1).cast("long")
    return rows.select("tried", "fine", segment.alias("segment"))


def note_finished(spark: SparkSession, table: str, writer: str, batch: int, folder: str) -> None:
    """Note the predictions that ``writer`` has written into ``folder`` of the table as its ``batch``.

    Batches of a writer follow one another; a repeated one replaces its own notes. Of each segment the
    two newest versions stay, since the newest may be of a batch that is repeated.
    """
    rows = spark.read.schema("index long, status string").parquet(f"{table}/{folder}").where("index IS NOT NULL")
    bit, fine = F.bitmap_bit_position("index"), F.col("status") != "error"
    new = rows.groupBy(F.bitmap_bucket_number("index").alias("segment")).agg(
        F.bitmap_construct_agg(bit).alias("tried"), F.bitmap_construct_agg(F.when(fine, bit)).alias("fine")
    )
    segments = [r["segment"] for r in new.select("segment").collect()]  # of one batch
    if segments:
        old = _read(spark, _newest(spark, table, segments, writer, below=batch))
        both = new.select("segment", "tried", "fine").unionByName(old)
        merged = both.groupBy("segment").agg(F.bitmap_or_agg("tried").alias("tried"), F.bitmap_or_agg("fine").alias("fine"))
        (
            merged.withColumn("batch", F.lit(batch))
            .repartition("segment")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("segment", "batch")
            .parquet(f"{_home(table)}/{writer}")
        )
        for (name, segment), batches in _versions(spark, table, writer, segments).items():
            for past in batches[:-2]:
                remove_folder(spark, f"{_home(table)}/{name}/segment={segment}/batch={past}")
    _mark(spark, f"{_home(table)}/{writer}", batch)


def _mark(spark: SparkSession, folder: str, batch: int) -> None:
    """Say up to which batch a writer's notes go."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_upto={batch}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()
    for entry in _listed(spark, f"{folder}/_upto=*"):
        if int(_name(entry).split("=")[1]) < batch:
            remove_folder(spark, entry.getPath().toString())


def _unnoted(spark: SparkSession, table: str) -> list[str]:
    """Files and folders of the table that no notes cover: names, no contents, are looked at."""
    upto = {}
    for entry in _listed(spark, f"{_home(table)}/*/_upto=*"):
        writer = entry.getPath().getParent().getName()
        upto[writer] = max(upto.get(writer, -1), int(_name(entry).split("=")[1]))
    found = []
    for entry in _listed(spark, f"{table}/*"):
        name = _name(entry)
        if name.startswith(("_", ".")):
            continue
        if not entry.isDirectory() or name not in upto:
            found.append(entry.getPath().toString())
            continue
        for batch in _listed(spark, f"{table}/{name}/batch_*"):
            if int(_name(batch).split("_")[1]) > upto[name]:
                found.append(batch.getPath().toString())
    return found


def segments_of(questions: DataFrame) -> list[int] | None:
    """The segments that the questions' indices lie in; None, for all, if they are very many."""
    distinct = questions.where("index IS NOT NULL").select(F.bitmap_bucket_number("index").alias("s")).distinct()
    found = [r["s"] for r in distinct.limit(MOST_SEGMENTS + 1).collect()]
    return None if len(found) > MOST_SEGMENTS else sorted(found)


def without_finished(
    questions: DataFrame, table: str, retry_errors: bool = False, repeats: tuple[str, int] | None = None
) -> DataFrame:
    """Questions whose index is not finished; those without an index stay.

    ``repeats`` names a writer and its batch: what these have written themselves in an earlier
    attempt does not count. Bitmaps are looked at for the segments of these questions only.
    """
    spark = questions.sparkSession
    segments = segments_of(questions)
    folders = _newest(spark, table, segments)
    unnoted = _unnoted(spark, table)
    if repeats:
        writer, batch = repeats
        folders = [f for f in folders if f"{SUFFIX}/{writer}/" not in f] + _newest(spark, table, segments, writer, below=batch)
        unnoted = [f for f in unnoted if not f.endswith(f"/{writer}/batch_{batch}")]
    kind = "fine" if retry_errors else "tried"
    done = _read(spark, folders).groupBy("segment").agg(F.bitmap_or_agg(kind).alias("bits"))
    number, position = F.bitmap_bucket_number("index"), F.bitmap_bit_position("index").cast("int")
    # a segment's bitmap goes to its questions; a byte of it, counted from 1, holds eight positions
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(position DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(octet, position % 8)").bitwiseAND(1) == 1, F.lit(False))
    placed = questions.withColumns({"segment": number, "position": position}).join(done, "segment", "left")
    left = placed.withColumn("octet", byte).where(~is_set).select(*questions.columns)
    if unnoted:
        rows = spark.read.schema("index long, status string").option("recursiveFileLookup", "true").parquet(*unnoted)
        rows = rows.where(F.col("status") != "error") if retry_errors else rows
        left = left.join(rows.where("index IS NOT NULL").select("index").distinct(), "index", "left_anti")
    return left.select(*questions.columns)


def runs_folder(writer: str, batch: int) -> str:
    """Where in the table a writer puts a batch."""
    if not re.fullmatch(r"\w[\w-]*", writer):
        raise ValueError(f"no name for a writer: {writer}")
    return f"{writer}/batch_{batch}"
