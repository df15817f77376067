"""Mixing sources to target weights: random order, distributed prefix sums, exact cuts.

Each document gets a random key from a hash of its id. Rows are sorted by source and
key into ranges; the ranges' sums per source give every range its offset, and a running
sum inside each range gives every document its place in its source's budget. No source
has to fit one task, and nothing depends on where the ranges are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Staging, broadcast_if_small, written

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MAX_EPOCHS = 3  # no source, and so no document, is used more often
SALT = "mix"
FEW = 50_000  # documents that may still fill gaps, from which on the driver goes through them


def word_count(text: Column) -> Column:
    """Number of words: runs without space, tab, newline, vertical tab, feed, return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _rank(ident: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(ident.cast("string"), F.lit("null"))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Source sizes (source, source_size) with ``target``: each source's share in words.

    All sizes together are shared by weight. A share stops at ``max_epochs`` times its
    source; what is left over goes to the others by weight, again until none is above.
    The result has a closed form: with sources ordered by the share of a unit weight at
    which they are full, those up to some point are full and the others get the rest by
    weight. (What is left for a unit weight rises up to that point and falls after it.)
    One row per source; the sources, unlike the documents, are ordered as a whole.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights)).cast("int") + 1)
    ranked = sources.withColumn(
        "n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", chosen)
    by_fill = W.orderBy(cap / F.col("weight"), "n")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    leveled = (
        ranked.withColumn("total", F.sum(F.col("source_size").cast("double")).over(W.partitionBy()))
        .withColumn("full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("unit", (F.col("total") - F.col("full")) / F.sum("weight").over(rest))
        .withColumn("is_full", cap / F.col("weight") <= F.col("unit"))
        .withColumn("level", F.max(F.when(~F.col("is_full"), F.col("unit"))).over(W.partitionBy()))
    )
    target = F.when(F.col("is_full"), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def _placed(rows: DataFrame, stage: Staging) -> DataFrame:
    """Rows (id, source, size, rank) sorted into ranges, written with the range's number."""
    ordered = rows.repartitionByRange("source", "rank", "id", "size").withColumn("range", F.spark_partition_id())
    return stage.write(ordered, "ranges")


def _fill(behind: DataFrame, stage: Staging) -> DataFrame:
    """(source, range, no) of the rows (source, range, no, size, gap) that fill the gaps.

    Each source's rows are gone through in the order of range and number, and each that fits
    into what is left of the gap is taken. As jobs: those that fit the gap are taken up to the
    first that does not fit behind the others. What is left is smaller than that one, so fewer
    are tried in the next round. The last ``FEW`` are gone through on the driver.
    """
    key, chosen = ["source", "range", "no"], []
    behind = stage.write(behind.where("size > 0 AND size <= gap"), "behind")
    while behind.count() > FEW:
        inside = W.partitionBy("range", "source").orderBy("no")
        running = behind.withColumn("running", F.sum("size").over(inside))
        earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        sums = behind.groupBy("source", "range").agg(F.sum("size").alias("n"))
        offsets = stage.write(
            sums.select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "offsets"
        )
        same = (F.col("r.range") == F.col("p.range")) & F.col("r.source").eqNullSafe(F.col("p.source"))
        tried = stage.write(
            running.alias("r").join(offsets.alias("p"), same).select(
                "r.source", "r.range", "r.no", "r.size", "r.gap", (F.col("p.offset") + F.col("r.running")).alias("place")
            ),
            "tried",
        )
        fits = F.col("place") <= F.col("gap")
        chosen.append(tried.where(fits).select(*key))
        left = stage.write(
            tried.groupBy("source").agg((F.first("gap") - F.max(F.when(fits, F.col("place")))).alias("gap")), "left"
        )
        behind = stage.write(
            tried.where(~fits).drop("gap", "place").alias("d")
            .join(broadcast_if_small(left).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
            .where("d.size <= g.gap").select("d.*", "g.gap"),
            "behind",
        )
    gaps, last = {}, []
    for r in sorted(behind.collect(), key=lambda r: (r["range"], r["no"])):
        left_over = gaps.get(r["source"], r["gap"])
        if r["size"] <= left_over:
            gaps[r["source"]] = left_over - r["size"]
            last.append((r["source"], r["range"], r["no"]))
    taken = behind.sparkSession.createDataFrame(last, behind.select(*key).schema)
    for more in chosen:
        taken = taken.unionByName(more)
    return stage.write(taken, "fill")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    salt: str = SALT,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies.

    A source's documents are all used as many times as its target holds its size, and
    once more, in random order, as long as the running sum stays within what remains. Behind
    that cut each document with words that fits into what is then left is taken, in the same
    order, so no document that is left out would fit. The order is by a hash of ``salt`` and the id,
    then id and size, so runs agree. Rows alike in source, id and size (nulls are equal to each other)
    are cut one by one.
    A null text has no words; documents without words can be taken and weigh nothing.
    Other columns of ``docs`` are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rank = _rank(F.col("id"), salt)
    with Staging(spark, "mix") as stage:
        rows = stage.write(
            docs.select(
                F.col(f"`{id_col}`").cast("long").alias("id"),
                F.col(f"`{source_col}`").cast("string").alias("source"),
                word_count(F.col(f"`{text_col}`")).alias("size"),
            ),
            "sizes",
        )
        placed = _placed(rows.withColumn("rank", rank), stage)
        sums = stage.write(
            placed.groupBy("source", "range").agg(F.sum("size").alias("n")), "sums"
        )  # a row per range and source that meets it: ranges plus sources at most
        wanted = stage.write(
            targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs), "targets"
        )
        earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        offsets = sums.select(
            "source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
        )
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        wanted = wanted.withColumn("epochs", epochs.cast("long")).withColumn(
            "rest", F.col("target") - F.col("epochs") * F.col("source_size")
        )
        on_source = F.col("o.source").eqNullSafe(F.col("t.source"))
        plan = stage.write(
            offsets.alias("o").join(wanted.alias("t"), on_source).select("o.*", "t.source_size", "t.target", "t.epochs", "t.rest"),
            "plan",
        )
        inside = W.partitionBy("range", "source").orderBy("rank", "id", "size")
        frame = inside.rowsBetween(W.unboundedPreceding, W.currentRow)  # also rows alike in the order have sums of their own
        running = placed.withColumn("running", F.sum("size").over(frame)).withColumn("no", F.row_number().over(inside))
        same = (F.col("r.range") == F.col("p.range")) & F.col("r.source").eqNullSafe(F.col("p.source"))
        placed_in = stage.write(
            running.alias("r").join(plan.alias("p"), same).select(
                "r.id", "r.source", "r.size", "r.rank", "r.range", "r.no", "p.source_size", "p.target", "p.epochs", "p.rest",
                (F.col("p.offset") + F.col("r.running")).alias("place"),
            ),
            "placed",
        )
        again = F.col("place") <= F.col("rest")
        gaps = placed_in.groupBy("source").agg(
            (F.first("rest") - F.coalesce(F.max(F.when(again, F.col("place"))), F.lit(0))).alias("gap")
        )
        with_gap = placed_in.alias("d").join(
            broadcast_if_small(stage.write(gaps, "gaps")).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))
        )
        fill = _fill(with_gap.where(~again).select("d.source", "range", "no", "size", "gap"), stage)
        on_fill = F.col("d.source").eqNullSafe(F.col("f.source"))
        on_fill &= (F.col("d.range") == F.col("f.range")) & (F.col("d.no") == F.col("f.no"))
        taken = again | F.col("f.no").isNotNull()
        copies = F.when(F.col("epochs") >= max_epochs, F.lit(max_epochs)).otherwise(
            F.col("epochs") + taken.cast("long")
        )
        filled = placed_in.alias("d").join(broadcast_if_small(fill).alias("f"), on_fill, "left")
        return written(
            filled.select("id", "d.source", "size", "source_size", "target", copies.cast("long").alias("copies")),
            "mixed",
        )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    salt: str = SALT,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns only.

    Texts do not move. In the random order a source's rows before its first one that is not taken
    once more are taken alike, and those behind alike, but for the few that fill the gap there:
    a source's rule is one row, and those few are no more than the words of one document hold.
    Where rows that share id and source are taken unequally often, they are numbered by
    their texts within their size, and the first of each size are used once more.
    """
    plan = mix(docs, id_col, text_col, source_col, weights, max_epochs, salt).withColumn("rank", _rank(F.col("id"), salt))
    firsts = plan.groupBy("source", "copies").agg(F.min("rank").alias("rank"))
    rule = firsts.groupBy("source").agg(F.min(F.struct("copies", "rank")).alias("first"), F.max("copies").alias("many"))
    rule = written(rule.select("source", F.col("first.copies").alias("few"), F.col("first.rank").alias("cut"), "many"), "rule")
    of_source = F.col("r.source").eqNullSafe(F.col("s.source"))
    behind = plan.alias("r").join(broadcast_if_small(rule).alias("s"), of_source).where("r.rank >= s.cut")
    times = behind.groupBy("r.id", "r.source").agg(
        F.max("copies").alias("copies"), F.min("copies").alias("least"), F.first("few").alias("few")
    )
    times = written(times.where("copies > few").drop("few"), "times")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    same = F.col("r.id").eqNullSafe(F.col("t.id")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    usual = F.when(_rank(F.col("r.id"), salt) < F.col("s.cut"), F.col("s.many")).otherwise(F.col("s.few"))
    ruled = rows.alias("r").join(broadcast_if_small(rule).alias("s"), of_source).select("r.*", usual.alias("usual"))
    each = ruled.alias("r").join(broadcast_if_small(times).alias("t"), same, "left")
    copies = F.coalesce("t.copies", "r.usual").alias("copies")
    taken = each.where("t.copies IS NULL OR t.copies = t.least").select("r.row", copies).where("copies > 0")
    apart = times.where("copies > least")
    if not apart.isEmpty():
        taken = taken.unionByName(_numbered(rows, plan, apart, text_col))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _numbered(rows: DataFrame, plan: DataFrame, apart: DataFrame, text_col: str) -> DataFrame:
    """(row, copies) of the rows whose id and source are in ``apart``, if there are any."""
    same = F.col("r.id").eqNullSafe(F.col("t.id")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    alike = F.col("r.size").eqNullSafe(F.col("t.size")) & same
    text = F.col("row").getField(text_col)
    own = written(
        rows.alias("r").join(apart.alias("t"), same).select("r.*", "t.least")
        .withColumn("size", word_count(text)).withColumn("at", F.monotonically_increasing_id()),
        "apart",
    )
    more = plan.alias("r").join(apart.alias("t"), same).where("r.copies > t.least")
    more = written(more.groupBy("r.id", "r.source", "size").agg(F.count(F.lit(1)).alias("n")), "more")
    # numbers without the texts: a task holds little of rows that are alike
    order = W.partitionBy("id", "source", "size").orderBy("digest", "at")
    numbers = own.select("id", "source", "size", "at", F.xxhash64(text).alias("digest")).withColumn("no", F.row_number().over(order))
    first = written(numbers.alias("r").join(more.alias("t"), alike).where("r.no <= t.n").select("r.at"), "first")
    again = own.join(first.withColumn("extra", F.lit(1)), "at", "left")
    copies = F.col("least") + F.coalesce(F.col("extra"), F.lit(0))
    return again.select("row", copies.alias("copies")).where("copies > 0")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sources
), weighed AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM ranked
), leveled AS (
  SELECT *,
         (sum(CAST(source_size AS DOUBLE)) OVER ()
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM weighed
), wanted AS (
  SELECT source, source_size,
         CASE WHEN cap / weight <= unit THEN cap
              ELSE least(cap, max(CASE WHEN cap / weight > unit THEN unit END) OVER () * weight) END AS target
  FROM leveled
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM wanted
), summed AS MATERIALIZED (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.epochs, target - epochs * source_size AS rest,
         sum(d.size) OVER w AS running, row_number() OVER w AS no
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
  WINDOW w AS (PARTITION BY d.source ORDER BY d.rank, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), behind AS MATERIALIZED (
  SELECT source, no, size FROM summed WHERE running > rest AND size > 0
), fill AS (
  SELECT source, max(CASE WHEN running <= rest THEN no ELSE 0 END) AS no,
         any_value(rest) - coalesce(max(CASE WHEN running <= rest THEN running END), 0) AS gap
  FROM summed GROUP BY source
  UNION ALL
  SELECT f.source, min(b.no), f.gap - arg_min(b.size, b.no)
  FROM fill f JOIN behind b ON f.source IS NOT DISTINCT FROM b.source AND b.no > f.no AND b.size <= f.gap
  GROUP BY f.source, f.no, f.gap
)
SELECT s.doc_id, s.size, s.source_size, s.target,
       CAST(s.size * CASE WHEN epochs >= 3 THEN 3
                          ELSE epochs + CASE WHEN running <= rest OR f.no IS NOT NULL THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM summed s LEFT JOIN fill f ON s.source IS NOT DISTINCT FROM f.source AND s.no = f.no AND s.running > s.rest
"""
