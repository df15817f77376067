"""Embedding near-dedup: exact threshold pairs by traversing two cover trees at once.

Unit vectors with a cosine of at least ``t`` are those at most sqrt(2 - 2 t) apart. The upper
levels of the tree are tables: a cell with too many vectors is split among pivots of its
own, each new cell has a covering radius, and pairs of cells that lie too far apart for
their radii are dropped level by level. The cells that are left are small. A task gets a
pair of them, builds a cover tree with halving radii for each and walks down both: node
pairs too far apart are pruned, node pairs that are close as a whole are counted as a
whole, and the rest is compared vector by vector.

Tasks return counts and spanning links, never all pairs, so a group of vectors that are all
alike costs no more to return than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructType

from ..storage import Staging, written
from .components import components

THRESHOLD = 0.93
CELL = 1024  # vectors in a cell that a task compares
FANOUT = 64  # pivots of a cell, in expectation at most
LEVELS = 24  # of tables; what is too large after them is compared as it is
LEAF = 24  # vectors in a node that is not split
SLACK = 1e-9  # of bounds, far above rounding; what lies within is compared exactly

_VECTOR = "id long, label string, key binary, vec binary"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles; no vector where it links with nothing."""
    for batch in batches:
        keys, vecs = [], []
        labels = batch.column(1).to_pylist()
        for ident, label, row in zip(batch.column(0).to_pylist(), labels, batch.column(2).to_pylist()):
            vec = None
            if ident is not None and label is not None and row and not any(x is None for x in row):
                own = np.array(row, np.float64) + 0.0
                if np.isfinite(own).all() and own.any():
                    vec = own.tobytes()
            vecs.append(vec)
            keys.append(None if vec is None else xxhash.xxh3_128_digest(vec))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())],
            names=["id", "label", "key", "vec"],
        )


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _rows(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


# -- Cover tree of one cell -------------------------------------------------------------


@dataclass
class Tree:
    """Nodes of one cell: center (a row), covering radius, rows below, children."""

    units: np.ndarray
    centers: list[int]
    radii: list[float]
    rows: list[np.ndarray]
    children: list[list[int]]


def cover_tree(units: np.ndarray) -> Tree:
    """Nested levels: a node's children are centers more than half its radius apart, which
    cover its rows within that half."""
    tree = Tree(units, [], [], [], [])

    def add(center: int, rows: np.ndarray, away: np.ndarray) -> int:
        tree.centers.append(center)
        tree.radii.append(float(away.max()))
        tree.rows.append(rows)
        tree.children.append([])
        return len(tree.centers) - 1

    def distances(center: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (units[rows] @ units[center])))

    every = np.arange(len(units))
    todo = [add(0, every, distances(0, every))]
    while todo:
        node = todo.pop()
        rows, half = tree.rows[node], tree.radii[node] / 2
        if len(rows) <= LEAF or half <= SLACK:
            continue
        left = rows
        center = tree.centers[node]
        while len(left):
            away = distances(center, left)
            inside = away <= half
            child = add(center, left[inside], away[inside])
            tree.children[node].append(child)
            todo.append(child)
            left = left[~inside]
            if len(left):
                center = int(left[0])
    return tree


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b) / (math.sqrt(float(a @ a)) * math.sqrt(float(b @ b)))


def dual_traversal(
    left: Tree, right: Tree, same: bool, threshold: float, raw_left: np.ndarray, raw_right: np.ndarray
) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Links between the rows of two trees, or within one: (blocks, pairs).

    A block is two arrays of rows all of which link with each other; pairs are two arrays
    side by side. Within one tree each pair of rows comes once, and blocks hold each pair of
    different rows once in either order or, if both arrays are the same, twice.
    """
    limit = math.sqrt(2 - 2 * threshold)
    blocks, pairs = [], []
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        own = same and a == b
        down_a, down_b = left.children[a] or [a], right.children[b] or [b]
        if down_a == [a] and down_b == [b]:
            rows_a, rows_b = left.rows[a], right.rows[b]
            cosines = left.units[rows_a] @ right.units[rows_b].T
            linked = cosines >= threshold
            for i, j in np.argwhere(np.abs(cosines - threshold) <= SLACK):
                linked[i, j] = _cosine(raw_left[rows_a[i]], raw_right[rows_b[j]]) >= threshold
            if own:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            if len(i):
                pairs.append((rows_a[i], rows_b[j]))
            continue
        centers_a = left.units[[left.centers[n] for n in down_a]]
        centers_b = right.units[[right.centers[n] for n in down_b]]
        away = np.sqrt(np.maximum(0.0, 2 - 2 * (centers_a @ centers_b.T)))
        reach = np.array([left.radii[n] for n in down_a])[:, None] + np.array([right.radii[n] for n in down_b])[None, :]
        near, all_near = away - reach <= limit + 1e-7, away + reach < limit - 1e-7
        if own:
            near, all_near = np.triu(near), np.triu(all_near)
        for i, j in np.argwhere(all_near):
            blocks.append((left.rows[down_a[i]], right.rows[down_b[j]]))
        # single vectors on both sides need no more steps
        single = np.array([len(left.rows[n]) == 1 for n in down_a])[:, None] & np.array([len(right.rows[n]) == 1 for n in down_b])
        direct = near & ~all_near & single
        if direct.any():
            i, j = np.nonzero(direct)
            if own:
                i, j = i[i != j], j[i != j]
            rows_a = np.array([left.rows[down_a[n]][0] for n in i], np.int64)
            rows_b = np.array([right.rows[down_b[n]][0] for n in j], np.int64)
            cosines = np.einsum("ij,ij->i", left.units[rows_a], right.units[rows_b]) if len(i) else np.empty(0)
            linked = cosines >= threshold
            for k in np.flatnonzero(np.abs(cosines - threshold) <= SLACK):
                linked[k] = _cosine(raw_left[rows_a[k]], raw_right[rows_b[k]]) >= threshold
            if linked.any():
                pairs.append((rows_a[linked], rows_b[linked]))
        todo += [(down_a[i], down_b[j]) for i, j in np.argwhere(near & ~all_near & ~single)]
    return blocks, pairs


def _linked_cells(threshold: float):
    """Of the vectors of a pair of cells: what each is linked with, and one link to its group."""
    schema = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("copies").to_numpy()
        raw = _rows(table.column("vec").to_pylist())
        same = not side.any()
        places = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))]
        trees = [cover_tree(_unit(raw[p])) for p in (places[:1] if same else places)]
        blocks, pairs = dual_traversal(trees[0], trees[-1], same, threshold, raw[places[0]], raw[places[1]])
        links = np.zeros(len(ids), np.int64)
        first, second = [], []
        for rows_a, rows_b in blocks:
            a, b = places[0][rows_a], places[1][rows_b]
            if same and rows_a is rows_b:
                links[a] += weight[a].sum() - weight[a]
            else:
                links[a] += weight[b].sum()
                links[b] += weight[a].sum()
                first.append(b)
                second.append(np.full(len(b), a[0]))
            first.append(a)
            second.append(np.full(len(a), b[0]))
        for rows_a, rows_b in pairs:
            a, b = places[0][rows_a], places[1][rows_b]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            first.append(a)
            second.append(b)
        label = np.arange(len(ids))
        if first:
            a, b = np.concatenate(first), np.concatenate(second)
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        touched = np.flatnonzero(links > 0)
        return pa.table([ids[touched], links[touched], ids[label[touched]]], schema=schema)

    return run


# -- Cells as tables ----------------------------------------------------------------------


@F.arrow_udf(StructType().add("child", IntegerType()).add("away", DoubleType()))
def _nearest(vec: pa.Array, pivots: pa.Array) -> pa.Array:
    """The pivot nearest to each vector, among those of its cell, and how far it is."""
    child, away, made = [], [], {}
    for v, p in zip(vec.to_pylist(), pivots.to_pylist()):
        if p is None:
            child.append(None)
            away.append(None)
            continue
        own = _unit(np.frombuffer(v, np.float64)[None, :])[0]
        if p not in made:
            made.clear()
            made[p] = _unit(np.frombuffer(p, np.float64).reshape(-1, len(own)))
        cosines = made[p] @ own
        best = int(cosines.argmax())
        child.append(best)
        away.append(math.sqrt(max(0.0, 2 - 2 * float(cosines[best]))))
    return pa.StructArray.from_arrays([pa.array(child, pa.int32()), pa.array(away, pa.float64())], ["child", "away"])


@F.arrow_udf(BinaryType())
def _joined_vectors(vecs: pa.Array) -> pa.Array:
    return pa.array([b"".join(v) for v in vecs.to_pylist()], pa.binary())


@F.arrow_udf(BooleanType())
def _may_link(a: pa.Array, b: pa.Array, reach: pa.Array) -> pa.Array:
    """Whether two centers are near enough for their cells' radii; unknown centers may be."""
    found = []
    for x, y, r in zip(a.to_pylist(), b.to_pylist(), reach.to_pylist()):
        if x is None or y is None:
            found.append(True)
            continue
        u, v = _unit(np.frombuffer(x, np.float64)[None, :])[0], _unit(np.frombuffer(y, np.float64)[None, :])[0]
        found.append(math.sqrt(max(0.0, 2 - 2 * float(u @ v))) <= r + 1e-7)
    return pa.array(found, pa.bool_())


def _split(points: DataFrame, sizes: DataFrame, stage: Staging, cell_size: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Points and cells of the next level: (cell, id, vec, copies), (parent, cell, center, radius).

    A large cell's pivots are those of its points whose hash falls below a limit: twice
    as many as there should be cells, ``FANOUT`` in expectation at most.
    """
    wanted = F.least(F.lit(FANOUT), F.ceil(F.col("n") / cell_size) * 2)
    share = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    large = sizes.where(F.col("n") > cell_size)
    pivots = (
        points.join(large, "cell")
        .where(share < wanted / F.col("n"))
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("p"))
        .select("cell", _joined_vectors(F.col("p.vec")).alias("pivots"))
    )
    pivots = stage.write(pivots, "pivots")
    found = points.join(pivots, "cell", "left").select(
        F.col("cell").alias("parent"), "id", "vec", "copies", "pivots", _nearest("vec", "pivots").alias("near")
    )
    moved = stage.write(
        found.select(
            "parent",
            F.when(F.col("near.child").isNull(), F.col("parent")).otherwise(F.concat_ws(".", "parent", "near.child")).alias("cell"),
            "id",
            "vec",
            "copies",
            F.when(F.col("near.child").isNotNull(), F.expr("substring(pivots, near.child * length(vec) + 1, length(vec))")).alias("center"),
            F.col("near.away").alias("away"),
        ),
        "moved",
    )
    cells = stage.write(
        moved.groupBy("parent", "cell").agg(F.first("center").alias("center"), F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")),
        "cells",
    )
    return moved.select("cell", "id", "vec", "copies"), cells


def _cell_pairs(pairs: DataFrame, known: DataFrame, stage: Staging, limit: float) -> DataFrame:
    """Pairs of the next level below ``pairs`` that may hold links. ``known`` has the center and
    radius of every cell; cells that were not split stay as they are."""
    side = known.select("parent", "cell", "center", "radius")
    a = side.select(F.col("parent").alias("a"), F.col("cell").alias("x"), F.col("center").alias("cx"), F.col("radius").alias("rx"))
    b = side.select(F.col("parent").alias("b"), F.col("cell").alias("y"), F.col("center").alias("cy"), F.col("radius").alias("ry"))
    below = pairs.join(a, "a").join(b, "b").where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
    reach = F.coalesce(F.col("rx") + F.col("ry"), F.lit(4.0)) + F.lit(limit)
    near = below.where((F.col("x") == F.col("y")) | _may_link("cx", "cy", reach))
    return stage.write(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "pairs")


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    cell_size: int = CELL,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows are linked when their labels are equal and not null, their vectors have the same
    length, and their cosine in doubles is at least ``threshold`` (positive). A vector that is
    null, empty or zero, or has null or non-finite components, and a row with a null id, links
    with nothing. Equal vectors are compared once. ``n_links`` counts rows. Rows with one id are
    separate rows of one component. Other columns are not read.

    The pairs of cells that no bound separates are all compared; vectors without any
    structure leave all pairs of cells, and the work is then quadratic.
    """
    spark, limit = vectors.sparkSession, math.sqrt(2 - 2 * threshold)
    with Staging(spark, "cover-tree") as stage:
        rows = stage.write(
            vectors.select(
                F.col(f"`{id_col}`").cast("long").alias("id"),
                F.col(f"`{label_col}`").cast("string").alias("label"),
                F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
            ).mapInArrow(_prepared, _VECTOR),
            "vectors",
        )
        valid = rows.where("vec IS NOT NULL")
        distinct = stage.write(
            valid.groupBy("label", "key").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies")),
            "distinct",
        )
        # the id of a vector among the others: ids may be repeated, label and key together are not
        named = stage.write(distinct.withColumn("node", F.xxhash64("label", "key")), "named")
        root = F.concat_ws("/", "label", (F.length("vec") / 8).cast("int"))
        points = named.select(root.alias("cell"), F.col("node").alias("id"), "vec", "copies")
        pairs = stage.write(points.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct(), "roots")
        sizes = stage.write(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
        centers = None
        for level in range(LEVELS):
            if sizes.where(F.col("n") > cell_size).isEmpty():
                break
            points, cells = _split(points, sizes, stage, cell_size, level)
            if centers is not None:
                old = centers.select(F.col("cell"), F.col("center").alias("c"), F.col("radius").alias("r"))
                cells = stage.write(
                    cells.join(old, "cell", "left").select(
                        "parent", "cell", F.coalesce("center", "c").alias("center"), F.coalesce("radius", "r").alias("radius"), "n"
                    ),
                    "cells",
                )
            pairs = _cell_pairs(pairs, cells, stage, limit)
            centers, sizes = cells, cells.select("cell", "n")
        left = pairs.join(points.withColumnRenamed("cell", "a"), "a").withColumn("side", F.lit(0))
        right = pairs.where("a <> b").join(points.withColumnRenamed("cell", "b"), "b").withColumn("side", F.lit(1))
        found = stage.write(
            left.unionByName(right)
            .groupBy("a", "b")
            .applyInArrow(_linked_cells(threshold), "id long, n_links long, other long"),
            "links",
        )
        groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), stage)
        counts = found.groupBy("id").agg(F.sum("n_links").alias("n"))
        of_node = (
            named.select("label", "key", "copies", F.col("id").alias("least"), F.col("node").alias("id"))
            .join(counts, "id", "left")
            .join(groups, "id", "left")
            .select("label", "key", "least", F.coalesce("component", "id").alias("component"),
                    (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        )
        of_node = stage.write(of_node, "nodes")
        least = stage.write(of_node.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        known = stage.write(of_node.join(least, "component").select("label", "key", "n_links", "component_id"), "known")
        linked = valid.select("id", "label", "key").join(known, ["label", "key"]).select("id", "n_links", "component_id")
        alone = rows.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        both = linked.unionByName(alone)
        return written(both.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), "embedding-groups")


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among those of its label."""
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", "kept"
    )


OP4_SQL = """
WITH RECURSIVE valid AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x : x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x
), found AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT f.vec_id, coalesce(c.n, 0) AS n_links, f.component_id, f.vec_id = f.component_id AS kept
FROM found f LEFT JOIN counted c ON c.x = f.vec_id
"""
