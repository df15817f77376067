"""MinHash near-dedup with tensored banding.

Two small collections of band keys are computed for each text, ``HALVES`` keys of
``ROWS`` minhashes each. A table key is a pair of them, one from either collection, so
there are ``HALVES`` squared tables for ``2 * HALVES * ROWS`` minhashes: the number of
minhashes grows with the square root of what as many tables would need on their own.

Candidates are verified on the full shingle sets. Texts with equal sets are one text from
the start. Texts that buckets connect form a cluster, and each text's set travels to its
cluster once. A cluster is compared as a whole inside a task, by an index of its shingles; the
task returns links that span its groups of near copies and never the pairs. A cluster too
large for a task is first compared with a few of its own sets. Most of a group of near copies is
joined by that and needs no further comparison with itself. The rest is cut into blocks, by size
of the sets first since sets of very different size cannot be linked, and compared with all that it
is not yet joined with; what is joined counts as one there, so links stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Staging, written
from .components import components
from .exact_dedup import parted
from .memory import lean

WORDS, PERCENT = 5, 80  # of the library's near-duplicates unless a caller says otherwise
HALVES, ROWS = 20, 4
SEED = 11
BATCH_SHINGLES = 1 << 18
BLOCK = 512  # sets on either side that a task compares
BLOCK_SHINGLES = 1 << 20  # and their shingles, on average at most; one set may hold more
STARS = 4  # sets of a large cluster that all others are compared with first

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words, sorted.

    A-Z count as lower case; words are runs without space, tab, newline, vertical tab,
    feed and return. A text with fewer words has one shingle, all of it; one without words
    has none.
    """
    own = (text or "").encode().translate(_LOWER).split()
    if not own:
        return np.empty(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
    codes = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64)
    n = len(codes) - words + 1
    value = codes[:n].copy()
    for k in range(1, words):
        value = (value ^ (value >> np.uint64(29))) * _STEP + codes[k : k + n]
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return np.unique(value ^ (value >> np.uint64(29)))


def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return (
        random.integers(0, 1 << 64, count, np.uint64, endpoint=False),
        random.integers(0, 1 << 64, count, np.uint64, endpoint=False) | np.uint64(1),
    )


def half_keys(sets: list[np.ndarray], halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """The 2 * ``halves`` keys of each non-empty set. The low five bits of a key are its place,
    so keys of different places never meet."""
    flips, factors = _parameters(2 * halves * rows)
    begins = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets)
    keys = np.zeros((len(sets), 2 * halves), np.uint64)
    for k in range(2 * halves):
        key = np.zeros(len(sets), np.uint64)
        for r in range(rows):
            values = (flat ^ flips[k * rows + r]) * factors[k * rows + r]
            least = np.minimum.reduceat(values, begins)
            key = (key ^ least ^ (key >> np.uint64(31))) * _MIX
        keys[:, k] = (key & ~np.uint64(63)) | np.uint64(k)
    return keys.view(np.int64)


_SIGNED = "doc long, digest binary, n long, halves array<long>"


def _set_digest(shingles: np.ndarray) -> bytes:
    """A 128-bit hash of a set, which stands for it."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(words: int, halves: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [k for k, s in enumerate(sets) if len(s)]
            lists: list = [None] * len(sets)
            if full:
                for k, own in zip(full, half_keys([sets[k] for k in full], halves, rows)):
                    lists[k] = own
            return pa.RecordBatch.from_pydict(
                {
                    "doc": pa.array(ids, pa.int64()),
                    "digest": pa.array([_set_digest(s) for s in sets], pa.binary()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "halves": pa.array(lists, pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            ids, sets, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                ids.append(i)
                sets.append(shingle_set(text, words))
                held += len(sets[-1])
                if held >= BATCH_SHINGLES:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": pa.array([_set_digest(s) for s in sets], pa.binary()),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )

    return run


def _spanning_links(percent: int):
    """Of the sets of one block, or of two, links that connect what all their links connect.

    Sets with the same ``joined``, if that is no -1, are connected already.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        two = bool(side.any())
        # what is joined is one: the first of it stands for all
        stands = np.arange(len(sets))
        joined = table.column("joined").to_numpy()
        _, first_of, back = np.unique(joined, return_index=True, return_inverse=True)
        stands[joined >= 0] = first_of[back][joined >= 0]
        # an index of the shingles that several of the sets hold
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
        begins, counts = edge[:-1], np.diff(edge)
        entry = np.repeat(np.arange(len(counts)), counts)
        shared = counts[entry] > 1
        own_order = np.argsort(owner[shared], kind="stable")
        own_entries, own_begins = entry[shared][own_order], np.searchsorted(owner[shared][own_order], np.arange(len(sets) + 1))
        label = np.arange(len(sets))
        first, second = [], []
        for x in range(len(sets)):
            if two and side[x]:
                continue
            held = own_entries[own_begins[x] : own_begins[x + 1]]
            if 100 * len(held) < percent * sizes[x]:
                continue
            n = counts[held]
            places = np.arange(n.sum()) + np.repeat(begins[held] - np.cumsum(n) + n, n)
            both = np.bincount(owner[places], minlength=len(sets))
            linked = 100 * both >= percent * (sizes[x] + sizes - both)
            linked &= (side == 1) if two else (np.arange(len(sets)) > x)
            linked &= stands != stands[x]
            found = np.unique(stands[linked])
            first.append(np.full(len(found), stands[x]))
            second.append(found)
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (first, second))
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(sets)))
        return pa.table([ids[label[moved]], ids[moved]], schema=schema)

    return run


def _edges(signed: DataFrame, stage: Staging, halves: int) -> DataFrame:
    """(a, b): the smallest set of each of the tables' buckets with each of the others in it.

    A pair of half keys can meet only where both do, so half keys that one set alone has
    are dropped before pairs are formed: most texts form none.
    """
    own_halves = stage.write(signed.select("id", F.explode("halves").alias("half")), "halves")
    shared = stage.write(own_halves.groupBy("half").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1").select("half"), "shared")
    place = F.col("half").bitwiseAND(63)
    own = (
        own_halves.join(shared, "half", "left_semi")
        .groupBy("id")
        .agg(
            F.collect_list(F.when(place < halves, F.col("half"))).alias("first"),
            F.collect_list(F.when(place >= halves, F.col("half"))).alias("second"),
        )
    )  # 2 * HALVES keys at most
    keyed = stage.write(
        own.select("id", F.explode("first").alias("x"), "second")
        .select("id", "x", F.explode("second").alias("y"))
        .select(F.xxhash64("x", "y").alias("key"), "id"),
        "keyed",
    )
    least = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_sets"), F.min("id").alias("center"))
    centers = stage.write(least.where("n_sets > 1").select("key", "center"), "centers")
    return keyed.join(centers, "key").where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b"))


def _clusters(sets: DataFrame, stage: Staging, halves: int) -> DataFrame:
    """(id, cluster): sets that buckets connect, in a row or directly."""
    return components(_edges(sets, stage, halves), stage).withColumnRenamed("component", "cluster")


def _parts(limit: int, block: int) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / limit)).cast("int")


def _blocks(
    members: DataFrame, stage: Staging, percent: int, block: int, block_shingles: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Members (id, n, cluster, is_small, joined) with their place (cluster, joined, band, part), and
    the pairs of places to compare.

    Small clusters share a place; none is cut. A large one is cut into bands by the
    logarithm of the set's size, so that only neighbouring bands can be linked, and a band into
    what is ``joined`` and what is not (-1), and these into as many parts as they need, by their
    shingles as by their sets. Places of the same ``joined`` are not compared.
    """
    limit = block_shingles or BLOCK_SHINGLES
    small = members.where("is_small").agg(F.count(F.lit(1)), F.sum("n")).first()
    packs = max(1, -(-(small[0] or 0) // (block // 2)), -(-(small[1] or 0) // max(1, limit // 2)))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) - F.lit(1e-9)).cast("int")
    banded = stage.write(
        members.select(
            "id", "n", "joined",
            F.when(F.col("is_small"), F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.col("cluster")).alias("cluster"),
            F.when(F.col("is_small"), F.lit(-1)).otherwise(band).alias("band"),
        ),
        "banded",
    )
    key = ["cluster", "joined", "band"]
    large = banded.where(F.col("band") >= 0).groupBy(*key).agg(_parts(limit, block).alias("parts"))
    packed = banded.where(F.col("band") < 0).select(*key).distinct().withColumn("parts", F.lit(1))
    bands = stage.write(large.unionByName(packed), "bands")
    placed = banded.join(bands, key).select("id", *key, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    one = bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    same = one.where("joined < 0").select(
        *key, "part", F.col("joined").alias("joined_2"), F.col("band").alias("band_2"),
        F.explode(F.sequence("part", F.col("parts") - 1)).alias("part_2"),
    )
    other = one.where("band >= 0").select(
        "cluster", F.col("joined").alias("joined_2"), F.col("band").alias("band_2"), F.col("part").alias("part_2")
    )
    beside = one.where("band >= 0").withColumn("band_2", F.explode(F.array("band", F.col("band") + 1)))
    across = beside.join(other, ["cluster", "band_2"]).where(
        "(band < band_2 AND (joined < 0 OR joined <> joined_2)) OR (band = band_2 AND joined < joined_2)"
    )
    names = [*key, "part", "joined_2", "band_2", "part_2"]
    pairs = same.select(*names).unionByName(across.select(*names))
    return placed, stage.write(pairs.withColumn("pair", F.xxhash64(*names)), "block-pairs")


def _sized(members: DataFrame, stage: Staging, block: int, limit: int) -> DataFrame:
    """Members (id, digest, doc, n, cluster) with ``is_small``: whether a task can take their cluster."""
    sizes = members.groupBy("cluster").agg(
        ((F.count(F.lit(1)) <= block) & (F.sum("n") <= limit // 4)).alias("is_small")
    )
    return stage.write(members.join(stage.write(sizes, "sizes"), "cluster"), "sized")


def _star_links(full: DataFrame, stage: Staging, percent: int, block: int, limit: int) -> DataFrame:
    """Links (a, b) of the sets of large clusters to those few that stand out by a hash."""
    large = full.where("NOT is_small")
    order = F.struct(F.xxhash64("id"), F.col("id"))
    # the least by hash of each of STARS shares: no cluster is sorted
    share = F.pmod(F.xxhash64(F.lit("star"), "id"), F.lit(STARS))
    centers = large.select("cluster", share.alias("share"), "id", order.alias("order"))
    centers = stage.write(centers.groupBy("cluster", "share").agg(F.min_by("id", "order").alias("id")).drop("share"), "stars")
    parts = stage.write(large.groupBy("cluster").agg(_parts(limit, block).alias("parts")), "star-parts")
    of_part = F.pmod(F.xxhash64("id"), "parts").cast("int")
    members = large.join(parts, "cluster").select(
        F.xxhash64("cluster", of_part).alias("pair"), F.lit(0).alias("side"), "id", F.lit(-1).cast("long").alias("joined"), "shingles"
    )
    repeated = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stars = stage.write(large.join(centers, ["cluster", "id"], "left_semi").select("cluster", "id", "shingles"), "star-sets")
    beside = stars.join(repeated, "cluster").select(
        F.xxhash64("cluster", "part").alias("pair"), F.lit(1).alias("side"), "id", F.lit(-1).cast("long").alias("joined"), "shingles"
    )
    both = members.unionByName(beside)
    return stage.write(both.groupBy("pair").applyInArrow(_spanning_links(percent), "a long, b long"), "star-links")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    halves: int = HALVES,
    rows: int = ROWS,
    block: int = BLOCK,
    block_shingles: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Texts are linked when at least ``percent`` of the union of their shingle sets is in both.
    Two texts at exactly 80 % meet in a bucket with a probability of 0.99995 at the default
    settings (0.41 for one half key; one of twenty in both collections); beyond that nothing
    is left to chance. Shingles are known by hashes of 64 bits, equal sets by such of 128. ``component_id`` is the
    smallest id that links reach; a text without words, or null, is linked with nothing. Rows
    with a null id are linked with nothing, keep a null component, and are kept. Rows with one id
    are judged by their own texts. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    with Staging(spark, "minhash") as stage:
        signed = stage.write(texts.mapInArrow(lean(_signed(words, halves, rows)), _SIGNED), "signed")
        known = signed.where("doc IS NOT NULL AND n > 0")
        distinct = known.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("halves").alias("halves"))
        sets = stage.write(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
        clusters = _clusters(sets, stage, halves)
        limit = block_shingles or BLOCK_SHINGLES
        members = _sized(sets.select("id", "digest", "doc", "n").join(clusters, "id"), stage, block, limit)
        # A filter of the documents asked for, of bounded size, spares their texts a shuffle. What
        # it lets through wrongly, and other rows of an id, give sets that the join drops.
        asked, _ = parted(texts.where("doc IS NOT NULL"), F.col("doc"), members.select(F.col("doc").alias("key")))
        made = asked.select("text").mapInArrow(lean(_sets(words)), "digest binary, shingles binary")
        full = stage.write(
            made.join(members, "digest").dropDuplicates(["id"]).select("id", "n", "cluster", "is_small", "shingles"), "sets"
        )
        stars = _star_links(full, stage, percent, block, limit)
        joined = components(stars, stage).select("id", F.col("component").alias("joined"))
        rest = members.select("id", "n", "cluster", "is_small").join(joined, "id", "left")
        placed, pairs = _blocks(rest.fillna(-1, ["joined"]), stage, percent, block, limit)
        place = ["cluster", "joined", "band", "part"]
        at_place = full.select("id", "shingles").join(placed, "id")
        left = at_place.join(pairs.select("pair", *place), place).withColumn("side", F.lit(0))
        other = pairs.where("band <> band_2 OR part <> part_2 OR joined <> joined_2").select(
            "pair", "cluster", *[F.col(f"{c}_2").alias(c) for c in ("joined", "band", "part")]
        )
        right = at_place.join(other, place).withColumn("side", F.lit(1))
        both = left.unionByName(right).select("pair", "side", "id", "joined", "shingles")
        found = both.groupBy("pair").applyInArrow(_spanning_links(percent), "a long, b long")
        links = stage.write(found.unionByName(stars), "links")
        groups = components(links, stage)
        named = stage.write(
            sets.select("id", "digest", "doc").join(groups, "id", "left")
            .select("digest", "doc", F.coalesce("component", "id").alias("component")),
            "groups",
        )
        least = stage.write(named.groupBy("component").agg(F.min("doc").alias("component_id")), "least")
        of_set = stage.write(named.join(least, "component").select("digest", "component_id"), "of-set")
        is_known = F.col("doc").isNotNull() & (F.col("n") > 0)
        linked = signed.where(is_known).join(of_set, "digest").select("doc", "n", "component_id")
        alone = signed.where(~is_known).select("doc", "n", F.col("doc").alias("component_id"))
        joined, component = linked.unionByName(alone), F.col("component_id")
        return written(
            joined.select(
                F.col("doc").alias("id"),
                F.col("n").alias("n_shingles"),
                "component_id",
                component.eqNullSafe(F.col("doc")).alias("kept"),
            ),
            "near-groups",
        )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies, by shingles of four words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, words=4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i : array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = c.x JOIN sizes b ON b.doc_id = c.y
  WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
), found AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, f.component_id, d.doc_id = f.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN found f ON f.doc_id = d.doc_id
"""
