"""Line dedup that can be undone: cuckoo filters in front of exact reference counts.

A store is a folder of three tables. ``refs`` says which document holds which line,
``counts`` how many documents hold each repeated line and which is the largest, and
``filters`` has, for each shard of the line hashes, a cuckoo filter of the repeated
lines. Documents are inserted and deleted; only the lines they hold are counted anew,
and their fingerprints enter or leave the filters. Cleaning probes the filters, so only lines
that are probably repeated meet the counts: inside the tasks that read the texts as long as
all filters fit there, else each line's hash goes to the filter of its shard. There are as
many shards as the number of repeated lines asks for, so that a filter stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Staging, new_folder, remove_folder, written
from .exact_dedup import parted
from .memory import lean

MIN_DOCS = 3
MIN_CODE_POINTS = 20
SHARDS = 64  # at least
SHARD_KEYS = 1 << 16  # repeated lines in a shard, on average, before there are more shards
FILTERS_BROADCAST_BYTES = 32 * 1024 * 1024

SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# -- Keys -----------------------------------------------------------------------------


def line_keys(text: str | None, min_code_points: int = MIN_CODE_POINTS) -> list[bytes | None]:
    """For each line the hash of its key, or None where the key is too short to count.

    The key is the line without spaces, tabs and line ends at both ends, A-Z in lower
    case. Its 128-bit hash stands for it.
    """
    keys: list[bytes | None] = []
    for line in (text or "").encode().translate(_LOWER).split(b"\n"):
        key = line.strip(SPACE)
        enough = len(key) >= min_code_points and (key.isascii() or len(key.decode()) >= min_code_points)
        keys.append(xxhash.xxh3_128_digest(key) if enough else None)
    return keys


def _shard(key: bytes, shards: int) -> int:
    return int.from_bytes(key[8:12], "big") % shards


# -- Cuckoo filter --------------------------------------------------------------------


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two buckets.

    Like any such filter it may say yes wrongly (about 8 in 65,536) and never no
    wrongly, provided that only inserted keys are deleted.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 16, data: bytes | None = None) -> None:
        self.table = (
            np.zeros((buckets, self.SLOTS), np.uint16)
            if data is None
            else np.frombuffer(data, np.uint16).reshape(-1, self.SLOTS).copy()
        )

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 16
        while buckets * cls.SLOTS * 0.8 < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = int.from_bytes(key[2:4], "little") or 1
        first = int.from_bytes(key[4:8], "little") & mask
        return mark, first, (first ^ (mark * 0x5BD1E995)) & mask

    def insert(self, key: bytes) -> bool:
        """False if there was no room; the filter has then lost a mark and must be made anew."""
        mark, first, second = self._places(key)
        for at in (first, second):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at, mask = first, len(self.table) - 1
        for turn in range(self.KICKS):
            slot = turn % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = (at ^ (mark * 0x5BD1E995)) & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> None:
        mark, first, second = self._places(key)
        for at in (first, second):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return mark in self.table[first] or mark in self.table[second]

    def to_bytes(self) -> bytes:
        return self.table.tobytes()


def _changed_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its old filter first, then keys to insert (1) or delete (-1).

    If there is no room, the shard's keys are asked for by an empty filter; see
    ``LineStore._change``.
    """

    def out(shard: int, made: CuckooFilter | None) -> pa.RecordBatch:
        data = b"" if made is None else made.to_bytes()
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "filter": pa.array([data], pa.binary())}
        )

    now, made, fits = None, None, True
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != now:
                if now is not None:
                    yield out(now, made if fits else None)
                now, made, fits = row["shard"], CuckooFilter(), True
            if row["change"] == 0:
                made, fits = CuckooFilter(data=row["key"]), True
            elif row["change"] > 0:
                fits = fits and made.insert(row["key"])
            elif fits:
                made.delete(row["key"])
    if now is not None:
        yield out(now, made if fits else None)


def _full_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of shards from all their keys, sorted by shard."""
    now, keys = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array([now], pa.int32()), "filter": pa.array([CuckooFilter.of(keys).to_bytes()], pa.binary())}
        )

    for batch in batches:
        for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now:
                if now is not None:
                    yield out()
                now, keys = shard, []
            keys.append(key)
    if now is not None:
        yield out()


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its filter first, then keys: those that are probably in the filter."""
    now, made = None, None
    for batch in batches:
        shards, filters = batch.column("shard").to_pylist(), batch.column("filter")
        keep = np.zeros(batch.num_rows, bool)
        for i, key in enumerate(batch.column("key").to_pylist()):
            if shards[i] != now:
                now, made = shards[i], None
            if key is None:
                made = CuckooFilter(data=filters[i].as_py())
            else:
                keep[i] = made is not None and key in made
        yield batch.select(["holder", "id", "key"]).filter(pa.array(keep))


# -- Store ----------------------------------------------------------------------------


class LineStore:
    """The line references of a set of documents, in a folder that all executors see.

    Every change writes the tables of a new version and then drops the old one. A
    document counts once for a line however often it, or another row with its id, holds
    it. Rows with a null id count for nothing.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str | None = None,
        min_docs: int = MIN_DOCS,
        min_code_points: int = MIN_CODE_POINTS,
        shards: int = SHARDS,
    ) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "line-store")
        self.min_docs, self.min_code_points, self.shards = min_docs, min_code_points, shards
        self.broadcast_bytes = FILTERS_BROADCAST_BYTES
        self.version = ""
        self.refs = spark.createDataFrame([], "key binary, id long")
        self.counts = spark.createDataFrame([], "key binary, n_docs long, last_id long")
        self.filters = spark.createDataFrame([], "shard int, filter binary")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents. Ids that are there already gain the lines they did not hold."""
        limit = self.min_code_points

        def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                ids, keys = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = {k for k in line_keys(text, limit) if k is not None}
                    ids += [i] * len(own)
                    keys += own
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "id": pa.array(ids, pa.int64())})

        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        found = rows.where("id IS NOT NULL").mapInArrow(lean(refs), "key binary, id long")
        with Staging(self.spark, "line-insert") as stage:
            new = stage.write(found, "new")
            if self.version:
                new = stage.write(new.join(self.refs, ["key", "id"], "left_anti"), "unseen")
                touched = self.refs.join(new.select("key").distinct(), "key", "left_semi").unionByName(new)
                self._change(stage, self.refs.unionByName(new), touched, new.select("key").distinct())
            else:
                self._change(stage, new, new, None)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out, by id; lines no longer repeated come back. Unknown ids do nothing."""
        gone_ids = ids.select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
        with Staging(self.spark, "line-delete") as stage:
            gone = stage.write(self.refs.join(gone_ids, "id", "left_semi").select("key").distinct(), "gone")
            left = stage.write(self.refs.join(gone_ids, "id", "left_anti").select("key", "id"), "left")
            self._change(stage, left, left.join(gone, "key", "left_semi"), gone)

    def _change(self, stage: Staging, refs: DataFrame, touched: DataFrame, keys: DataFrame | None) -> None:
        """The next version: ``touched`` has all references to ``keys`` (None: to all keys)."""
        version = new_folder(self.spark, "version").rsplit("-", 1)[1]
        place = f"{self.folder}/{version}"
        recounted = stage.write(
            touched.groupBy("key")
            .agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("last_id"))
            .where(F.col("n_docs") >= self.min_docs),
            "recounted",
        )
        rest = self.counts if keys is None else self.counts.join(keys, "key", "left_anti")
        before = self.counts if keys is None else self.counts.join(keys, "key", "left_semi")
        counts = written(rest.unionByName(recounted), "counts", f"{place}/counts")
        n_lines, shards = counts.count(), self.shards
        while n_lines > shards * SHARD_KEYS:
            shards *= 2
        if not self.version or shards != self.shards:
            self.shards = shards
            made = counts.select(self._shard_column(), "key").repartition("shard").sortWithinPartitions("shard")
            self._next(version, refs, counts, made.mapInArrow(_full_filters, "shard int, filter binary"))
            return
        entered = recounted.join(before, "key", "left_anti").select("key", F.lit(1).alias("change"))
        left = before.join(recounted, "key", "left_anti").select("key", F.lit(-1).alias("change"))
        shard = self._shard_column()
        changes = (
            entered.unionByName(left)
            .withColumn("shard", shard)
            .unionByName(self.filters.select("shard", F.col("filter").alias("key"), F.lit(0).alias("change")))
        )
        ordered = changes.select(
            "shard", "key", "change", F.when(F.col("change") == 0, 0).otherwise(1).alias("after")
        ).repartition("shard").sortWithinPartitions("shard", "after", "change")
        made = stage.write(ordered.select("shard", "key", "change").mapInArrow(_changed_filters, "shard int, filter binary"), "filters")
        full = made.where(F.length("filter") == 0).select("shard")
        again = (
            counts.select(shard.alias("shard"), "key")
            .join(full, "shard", "left_semi")
            .repartition("shard")
            .sortWithinPartitions("shard")
            .mapInArrow(_full_filters, "shard int, filter binary")
        )
        self._next(version, refs, counts, made.where(F.length("filter") > 0).unionByName(again))

    def _next(self, version: str, refs: DataFrame, counts: DataFrame, filters: DataFrame) -> None:
        """Write what is left of a version and drop the one before it."""
        place = f"{self.folder}/{version}"
        filters = written(filters, "filters", f"{place}/filters")
        refs = written(refs.select("key", "id"), "refs", f"{place}/refs")
        old, self.version = self.version, version
        self.refs, self.counts, self.filters = refs, counts, filters
        if old:
            remove_folder(self.spark, f"{self.folder}/{old}")

    def _shard_column(self):
        number = F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long")
        return (number % self.shards).cast("int").alias("shard")

    def _filters_fit(self) -> bool:
        """Whether the filters are small enough together to be sent to the tasks."""
        return (self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= self.broadcast_bytes

    def _routed(self, keys: DataFrame) -> DataFrame:
        """Of rows (holder, id, key) those whose key the filter of its shard has."""
        nothing = {"holder": F.lit(None).cast("string"), "id": F.lit(None).cast("long"), "key": F.lit(None).cast("binary")}
        rows = keys.select("*", self._shard_column(), F.lit(None).cast("binary").alias("filter"))
        both = rows.unionByName(self.filters.withColumns(nothing))
        order = ["shard", F.col("filter").isNull()]
        return both.repartition("shard").sortWithinPartitions(*order).mapInArrow(_probed, "holder string, id long, key binary")

    def _probe(self) -> Callable[[list[bytes]], list[bytes]]:
        """Of some keys those that are probably repeated, by filters that are sent to the tasks."""
        sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})
        shards, made = self.shards, {}

        def probe(keys: list[bytes]) -> list[bytes]:
            if not made:
                made.update({s: CuckooFilter(data=d) for s, d in sent.value.items()})
            return [k for k in keys if (s := _shard(k, shards)) in made and k in made[s]]

        return probe

    def drop(self) -> None:
        """Delete the store's folder. What ``clean`` has returned does not read it."""
        remove_folder(self.spark, self.folder)

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` as rows of (row, id, text, n_lines, n_dropped).

        ``row`` is the whole input row, so no column of it can clash; ``text`` is what is
        left. Lines with a key that ``min_docs`` documents of the store hold are dropped,
        but for those in the largest of these documents. In a row with a null id all lines
        with such a key are dropped. A null or empty text is one empty line.
        """
        limit, fit = self.min_code_points, self._filters_fit()
        probe = self._probe() if fit else list

        def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                rows, ids, keys = [], [], []
                for r, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                    own = probe(list({k for k in line_keys(text, limit) if k is not None}))
                    rows += [r] * len(own)
                    ids += [i] * len(own)
                    keys += own
                yield pa.RecordBatch.from_pydict(
                    {"holder": pa.array(rows, pa.string()), "id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())}
                )

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                texts, lines, dropped = [], [], []
                held = batch.column("row").field(text_col).to_pylist()
                for text, gone in zip(held, batch.column("gone").to_pylist()):
                    own = (text or "").split("\n")
                    lines.append(len(own))
                    if gone:
                        gone = set(gone)
                        kept = [x for x, k in zip(own, line_keys(text, limit)) if k not in gone]
                        dropped.append(len(own) - len(kept))
                        texts.append("\n".join(kept))
                    else:
                        dropped.append(0)
                        texts.append(text or "")
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                    names=[*batch.schema.names[1:], "text", "n_lines", "n_dropped"],
                )

        ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
        holder = F.coalesce(ident.cast("string"), F.concat(F.lit("~"), F.sha2(F.coalesce(text, F.lit("")), 256)))
        with Staging(self.spark, "line-clean") as stage:
            probed = docs.select(holder.alias("holder"), ident.alias("id"), text.alias("text"))
            keys = probed.mapInArrow(lean(suspects), "holder string, id long, key binary")
            found = stage.write(keys if fit else self._routed(keys), "suspects")
            gone = (
                found.join(self.counts, "key")
                .where("id IS NULL OR id < last_id OR id > last_id")
                .groupBy("holder")
                .agg(F.collect_set("key").alias("gone"))
            )  # a document's own lines at most
            gone = written(gone, "line-drops")
        # texts that lose nothing stay where they are; the others travel once, inside their rows. The
        # join is a shuffle at any size, so a plan found on a small table holds on a large one.
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), holder.alias("holder"), ident.alias("id"))
        losing, whole = parted(rows, F.col("holder"), gone.select(F.col("holder").alias("key")))
        losing = losing.join(gone.hint("merge"), "holder", "left").select("gone", "row", "id")
        cleaned = losing.mapInArrow(lean(drop), _schema(rows.select("row", "id"), "text string, n_lines long, n_dropped long"))
        same = F.coalesce(F.col("row").getField(text_col), F.lit(""))
        n_lines = F.size(F.split(same, "\n", -1)).cast("long")
        return cleaned.unionByName(
            whole.select("row", "id", same.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
        )


ROWS_AT_ONCE = 512


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few enough rows to be held as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least three documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = LineStore(spark)
    store.insert(docs)
    cleaned = store.clean(docs)
    store.drop()
    return cleaned.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS n FROM cut
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), counts AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last_id AS dropped
  FROM keyed k LEFT JOIN counts c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
