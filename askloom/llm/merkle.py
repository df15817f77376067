"""Merkle manifests of a dataset: a content-addressed store of nodes, and proofs by descent.

Every row is a leaf. The leaves of a group, in the order of their ids, are the lowest level of a
tree of eight children to a node; the groups' roots are the leaves of one more such tree, whose
root stands for the dataset. What is stored of a node is a record from its digest to the digests of
its children, kept by level.

A proof needs the siblings of every node between a leaf and the root. Requests for leaves descend
from the root by the digits, to base eight, of their rank: at each node they look its children up by
its digest, leave those not selected behind in the path, and go on with the selected one. Requests
with the same digits so far are one row, so a node is looked up once, and neither the root nor
any other node is a hot key. The paths of siblings, collected downwards, are reversed at the leaf.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Staging, broadcast_if_small, new_folder, remove_folder, written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before: binary, after: binary>>"


def digest(data: Column) -> Column:
    """The SHA-256 of a text or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def as_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; texts of ASCII alone the quick way."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


class Manifest(NamedTuple):
    """What ``build`` makes, below ``folder``.

    ``leaves`` (place, rank, depth, leaf and the columns given with them): ``place`` is the number of
    the leaf's group, ``rank`` its own in the group, ``depth`` the height of the group's tree.
    ``groups`` (group, place, n, depth, subroot). ``records`` and ``top`` (level, digest, children):
    the nodes of the groups' trees and of the tree above them. ``root`` is null for an empty table.
    """

    folder: str
    leaves: DataFrame
    groups: DataFrame
    records: DataFrame
    top: DataFrame
    root: bytes | None
    top_depth: int

    def drop(self) -> None:
        remove_folder(self.leaves.sparkSession, self.folder)


def _depth(n: Column) -> Column:
    """The number of levels above ``n`` leaves. Exact: no logarithms."""
    total = F.lit(0)
    for k in range(21):  # 8 ** 21 exceeds any count
        total = total + F.when(n > ARITY**k, 1).otherwise(0)
    return total.cast("int")


def _ranked(leaves: DataFrame, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """Leaves with place, rank and depth; the groups. Numbers come from a range sort and prefix
    counts: no group has to fit a task, nor have rows that are alike, which ``at`` tells apart."""
    rows = stage.write(leaves, "leaves").withColumn("at", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in ("group", "id", "leaf", "at")]
    ranges = stage.write(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = stage.write(ranges.groupBy("range", "group").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("group").agg(F.sum("n").alias("n"))
    # one row a group: these, unlike the leaves, are numbered as a whole
    place = F.row_number().over(W.orderBy(F.asc_nulls_first("group"))).cast("long") - 1
    groups = stage.write(sizes.withColumn("place", place).withColumn("depth", _depth(F.col("n"))), "places")
    earlier = W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("range", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    plan = offsets.alias("o").join(groups.alias("g"), F.col("o.group").eqNullSafe(F.col("g.group")))
    plan = stage.write(plan.select("o.range", "o.group", "offset", "place", "depth"), "plan")
    inside = W.partitionBy("range", "group").orderBy(*order[1:])
    numbered = ranges.withColumn("no", F.row_number().over(inside).cast("long") - 1)
    same = (F.col("r.range") == F.col("p.range")) & F.col("r.group").eqNullSafe(F.col("p.group"))
    ranked = numbered.alias("r").join(broadcast_if_small(plan).alias("p"), same)
    return ranked.select("r.*", "place", "depth", (F.col("offset") + F.col("no")).alias("rank")).drop("at", "range", "no"), groups


def _raised(nodes: DataFrame, depth: int, path: str, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """The records of all trees over ``nodes`` (place, depth, rank, digest), and the trees' roots.

    Levels are written one after the other, each with an eighth of the rows of the one below. Records of a
    level are distinct by digest, so equal parts of the data are stored once.
    """
    spark = nodes.sparkSession
    schema = "digest binary, children array<binary>, level int"
    records, roots = spark.createDataFrame([], schema), nodes.where("depth = 0")
    for level in range(1, depth + 1):
        runs = nodes.where(F.col("depth") >= level).groupBy("place", "depth", F.floor(F.col("rank") / ARITY).alias("rank"))
        joined = runs.agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("at"), "digest"))).alias("run"))
        children = F.col("run.digest")
        hashed = joined.select("place", "depth", "rank", children.alias("children"))
        hexes = F.array_join(F.transform("children", as_hex), "")
        above = stage.write(hashed.withColumn("digest", digest(hexes)), "level")
        stored = above.groupBy("digest").agg(F.first("children").alias("children"))
        stored.write.parquet(f"{path}/level={level}")
        nodes = above.drop("children")
        roots = roots.unionByName(nodes.where(F.col("depth") == level))
    if depth:
        records = spark.read.schema(schema).parquet(path)
    return records, roots


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (group, id, leaf and any other columns, which are kept).

    Groups are ordered with null first, then by bytes; leaves by id with null first, and rows that share
    an id by their digests. Rows that are alike in these are leaves of their own, side by side. An empty
    table has no root.
    """
    spark = leaves.sparkSession
    folder = new_folder(spark, "manifest")
    with Staging(spark, "merkle") as stage:
        ranked, places = _ranked(leaves, stage)
        ranked = written(ranked, "leaves", f"{folder}/leaves")
        most = places.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.count(F.lit(1)).alias("n")).first()
        nodes = ranked.select("place", "depth", "rank", F.col("leaf").alias("digest"))
        records, roots = _raised(nodes, most["depth"], f"{folder}/records", stage)
        groups = written(
            places.join(roots.select("place", F.col("digest").alias("subroot")), "place"), "groups", f"{folder}/groups"
        )
        top_depth = 0
        while ARITY**top_depth < most["n"]:
            top_depth += 1
        tops = groups.select(
            F.lit(0).cast("long").alias("place"),
            F.lit(top_depth).alias("depth"),
            F.col("place").alias("rank"),
            F.col("subroot").alias("digest"),
        )
        top, root = _raised(tops, top_depth, f"{folder}/top", stage)
        found = root.select("digest").first()
        return Manifest(folder, ranked, groups, records, top, bytes(found["digest"]) if found else None, top_depth)


def _siblings(i: Column, children: Column) -> Column:
    """The children before and after the one at ``i``, each put together."""
    none = F.lit(b"")

    def joined(part: Column) -> Column:
        return F.aggregate(part, none, lambda found, more: F.concat(found, more))

    after = F.slice(children, i + 2, F.greatest(F.size(children) - i - 1, F.lit(0)))
    return F.struct(joined(F.slice(children, F.lit(1), i)).alias("before"), joined(after).alias("after"))


def _below(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """One step of all requests: frontier (place, depth, at, digest, path) to the children."""
    looked_up = frontier.join(records, "digest").select("place", "depth", "at", "path", "children")
    each = looked_up.select("*", F.posexplode("children").alias("i", "digest"))
    return each.select(
        "place", "depth", (F.col("at") * ARITY + F.col("i")).alias("at"), "digest",
        F.concat("path", F.array(_siblings(F.col("i"), F.col("children")))).cast(_PATH).alias("path"),
    )


def _wanted(requests: DataFrame | None, key: str, stage: Staging, depth: int) -> list[DataFrame | None]:
    """For each height the distinct places of the nodes that requests pass, from the leaves up."""
    if requests is None:
        return [None] * (depth + 1)
    found = [stage.write(requests.select("place", F.col(key).alias("at")).distinct(), "wanted")]
    for _ in range(depth):
        up = found[-1].select("place", F.floor(F.col("at") / ARITY).alias("at")).distinct()
        found.append(stage.write(up, "wanted"))
    return found


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Leaves with ``path``: the siblings before and after, from the leaf's run up to the root.

    ``requests`` (place, rank) says which leaves; without it, all are asked for. Nodes that lead to no
    requested leaf are not visited. Read the result before ``manifest`` is dropped.
    """
    spark = manifest.leaves.sparkSession
    empty = F.array().cast(_PATH)
    leaves = manifest.leaves
    if requests is not None:
        leaves = leaves.join(requests, ["place", "rank"], "left_semi").select(*leaves.columns)
    with Staging(spark, "descent") as stage:
        tall = manifest.groups.agg(F.max("depth").alias("d")).first()["d"] or 0
        places = None if requests is None else requests.select(F.lit(0).cast("long").alias("place"), F.col("place").alias("rank"))
        by_place = _wanted(places, "rank", stage, manifest.top_depth)
        by_rank = _wanted(requests, "rank", stage, tall)

        # from the root to the groups
        start = [] if manifest.root is None else [(0, manifest.top_depth, 0, bytearray(manifest.root))]
        frontier = spark.createDataFrame(start, "place long, depth int, at long, digest binary").withColumn("path", empty)
        for height in range(manifest.top_depth, 0, -1):
            frontier = _below(frontier, manifest.top.where(F.col("level") == height).drop("level"))
            if by_place[height - 1] is not None:
                frontier = frontier.join(by_place[height - 1], ["place", "at"], "left_semi")
            frontier = stage.write(frontier, "step")
        heads = frontier.select(F.col("at").alias("place"), "digest", "path")
        frontier = stage.write(
            manifest.groups.select("place", "depth").join(heads, "place").withColumn("at", F.lit(0).cast("long")), "heads"
        )

        # from the groups to the parents of leaves, each with its children; a lone leaf is its own
        parents = frontier.where("depth = 0").select("place", "at", "path", F.array().cast("array<binary>").alias("children"))
        for height in range(tall, 0, -1):
            records = manifest.records.where(F.col("level") == height).drop("level")
            here = frontier.where(F.col("depth") >= height)
            if height == 1:
                parents = parents.unionByName(here.join(records, "digest").select("place", "at", "path", "children"))
                break
            below = _below(here, records)
            if by_rank[height - 1] is not None:
                below = below.join(by_rank[height - 1], ["place", "at"], "left_semi")
            frontier = stage.write(below.unionByName(frontier.where(F.col("depth") < height)), "step")

        own = _siblings(F.pmod("rank", F.lit(ARITY)).cast("int"), F.col("children"))
        upwards = F.reverse("p.path")
        path = F.when(F.size("children") == 0, upwards).otherwise(F.concat(F.array(own), upwards)).cast(_PATH)
        same = (F.col("l.place") == F.col("p.place")) & (F.floor(F.col("l.rank") / ARITY) == F.col("p.at"))
        found = leaves.alias("l").join(stage.write(parents, "parents").alias("p"), same).select("l.*", path.alias("path"))
        return written(found, "proofs", f"{manifest.folder}/proofs-{uuid.uuid4().hex}")


def proof_digest(path: Column) -> Column:
    """The SHA-256 of all siblings on a path, leaf's run first."""
    parts = F.transform(path, lambda step: F.concat(as_hex(step["before"]), as_hex(step["after"])))
    return F.sha2(F.array_join(parts, ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give, as 32 bytes."""
    return F.aggregate(path, leaf, lambda node, step: digest(as_hex(F.concat(step["before"], node, step["after"]))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether its text, tampered with in a
    third of them, still gives the root.

    Null ids are leaves before all others and are not tampered with; rows that share an id are leaves
    each. Null texts stay null. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED_EVERY)) == 0
    fields = {c: F.col(c) for c in FIELDS}
    other = fields | {"text": lower_ascii(F.col("text"))}
    leaves = docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").alias("id"),
        leaf_digest(list(fields.values())).alias("leaf"),
        F.when(chosen, leaf_digest(list(other.values()))).alias("tampered"),
    )
    manifest = build(leaves)
    root = F.lit(manifest.root).cast("binary")
    subroots = manifest.groups.select("place", "subroot")
    proofs = prove(manifest).join(broadcast_if_small(subroots), "place")
    found = proofs.select(
        F.col("id").alias("doc_id"),
        as_hex(F.col("leaf")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        as_hex(root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("again"),
    )
    result = written(
        found.select("*", as_hex(F.col("again")).alias("folded_root"), F.col("again").eqNullSafe(root).alias("verified")).drop("again"),
        "merkle-proofs",
    )
    manifest.drop()
    return result


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_RUN = "PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN"

OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
                                lambda i: [ord((doc_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[] AS steps
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN xor(list_reduce(steps, lambda c, v: CASE WHEN v >= 0 THEN xor(c, v)
                                   ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295) % 3 = 0
              THEN {_leaf_sql("lowered")} ELSE {_leaf_sql("text")} END AS given
  FROM bits
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, rank AS pos, leaf AS digest, n FROM ranked
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT NULL AS lang, 0 AS level, place AS pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM tops WHERE n > 1 GROUP BY lang, level, pos // 8, n
), beside AS (
  SELECT lang, level, pos, coalesce(string_agg(digest, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
         coalesce(string_agg(digest, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM nodes WHERE n > 1
), above AS (
  SELECT level, pos, coalesce(string_agg(digest, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
         coalesce(string_agg(digest, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM tops WHERE n > 1
), steps AS (
  SELECT r.doc_id, r.leaf, 0 AS tier, level, b, a FROM ranked r JOIN beside s
    ON r.lang IS NOT DISTINCT FROM s.lang AND r.rank // (8 ** s.level)::BIGINT = s.pos
  UNION ALL
  SELECT r.doc_id, r.leaf, 1, level, b, a FROM ranked r JOIN subroots g ON r.lang IS NOT DISTINCT FROM g.lang
    JOIN above s ON g.place // (8 ** s.level)::BIGINT = s.pos
), paths AS (
  SELECT doc_id, leaf, list({{'b': b, 'a': a}} ORDER BY tier, level) AS path FROM steps GROUP BY ALL
), proofs AS (
  SELECT r.doc_id, r.leaf, g.subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
         sha256(coalesce(array_to_string(list_transform(path, lambda s: s.b || s.a), ''), '')) AS proof_sha256,
         list_reduce(coalesce(path, []), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}, {{'b': given, 'a': ''}}).b AS folded_root
  FROM ranked r JOIN subroots g ON r.lang IS NOT DISTINCT FROM g.lang
    LEFT JOIN paths p ON r.doc_id IS NOT DISTINCT FROM p.doc_id AND r.leaf = p.leaf
)
SELECT *, folded_root = root AS verified FROM proofs
"""
