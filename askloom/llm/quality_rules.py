"""Quality rules: statistics of each text, fixed base rules, and robust outliers.

Documents that pass the base rules become vectors of four transformed statistics: the mean
length of a word, the shares of symbols in the letters, of repeated lines, and of words in
repeated windows. For each language and source the centre and the covariance of the vectors
are estimated by the minimum covariance determinant: those of the half of the documents
that lies closest together. Documents far from the centre by Mahalanobis distance go.

An estimate is found by concentration steps from the medians. A step is one aggregate: the
vectors' distances are cut into narrow bins, every bin has its count, sums and sums of
products, and the bins that hold the nearest half give the next centre and covariance. The
sums are of whole numbers, so no order of addition changes a result. Only column functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..storage import Staging, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SCALE = 512  # statistics are whole multiples of 1 / SCALE
DIMS = 4
#: The least standard deviation of each statistic: smaller differences are no sign of anything.
FLOORS = (0.08, 0.05, 0.15, 0.15)
STEPS = 5
MIN_GROUP = 50  # documents that an estimate needs
BINS = 64  # to a unit of distance
FAR = 64  # all distances beyond are one bin

# Of the chi-squared distribution with four degrees of freedom.
HALF_FACTOR = 2.109  # of the covariance of all to that of the nearest half
CUT = 23.51  # 99.99 % of squared distances are smaller


# -- Statistics -----------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _window(words: Column, start: Column) -> Column:
    return F.slice(words, start + 1, WINDOW_WORDS)


def _covered(words: Column, hashes: Column) -> Column:
    """Number of words in windows that occur twice or more, given the windows' hashes.

    Starts are sorted by hash, so equal windows are neighbours; the words themselves decide.
    """

    def starts(found: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return (found[a]["h"] == found[b]["h"]) & (_window(words, found[a]["i"]) == _window(words, found[b]["i"]))

        last = F.size(found) - 1
        again = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: F.when(k > 0, equal(k - 1, k)).otherwise(False) | F.when(k < last, equal(k, k + 1)).otherwise(False),
        )
        return F.sort_array(F.transform(again, lambda k: found[k]["i"]))

    def length(places: Column) -> Column:
        last = F.size(places) - 1
        gaps = F.transform(
            places, lambda p, k: F.when(k < last, F.least(places[k + 1] - p, F.lit(WINDOW_WORDS))).otherwise(WINDOW_WORDS)
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, gap: n + gap)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, lambda found: _let(starts(found), length))


def repeated_words(words: Column) -> Column:
    """Number of words in windows of eight words found twice or more, the first included."""
    none = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW_WORDS), lambda i: F.xxhash64(_window(words, i)))
    some = _let(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(words, h))
    )
    return F.when(F.size(words) <= WINDOW_WORDS, none).otherwise(some)


def text_statistics(text: Column) -> dict[str, Column]:
    """Columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words are runs without space, tab and line ends. Lines are split at newlines and count if
    they have a word. A null text has none of anything. Words and lines are found once for a text.
    """
    text = F.coalesce(text, F.lit(""))
    words = _let(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = _let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)),
        lambda found: F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        ),
    )
    return {"words": words, "lines": lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long")}


# -- Vectors and estimates ------------------------------------------------------------


def _vector() -> list[Column]:
    """The square roots of the statistics, rounded to whole multiples of 1 / SCALE."""
    shares = [
        F.col("word_chars") / F.col("n_words"),
        F.col("n_symbols") / F.col("word_chars"),
        F.col("n_dup_lines") / F.col("n_lines"),
        F.col("n_repeat_words") / F.col("n_words"),
    ]
    return [F.floor(F.sqrt(s) * SCALE + 0.5).cast("long").alias(f"x{i}") for i, s in enumerate(shares)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _grouped(rows: DataFrame, stage: Staging) -> DataFrame:
    """Rows with ``group``: language and source; those of small groups by language, else all."""
    for level in ("all", "lang", "source"):
        key = F.struct(
            F.lit(level).alias("level"),
            (F.lit(None).cast("string") if level == "all" else F.col("lang")).alias("lang"),
            (F.col("source") if level == "source" else F.lit(None).cast("string")).alias("source"),
        )
        rows = rows.withColumn(f"by_{level}", key)
    counts = stage.write(rows.groupBy("by_all", "by_lang", "by_source").agg(F.count(F.lit(1)).alias("n")), "counts")
    small = F.col("n") < MIN_GROUP
    by_lang = counts.where(small).groupBy("by_lang").agg((F.sum("n") >= MIN_GROUP).alias("enough"))
    chosen = (
        counts.join(by_lang, "by_lang", "left")
        .withColumn(
            "group", F.when(~small, F.col("by_source")).when(F.col("enough"), F.col("by_lang")).otherwise(F.col("by_all"))
        )
        .select("by_source", "group")
    )
    return stage.write(
        lookup_join(rows.drop("by_all", "by_lang"), stage.write(chosen, "groups"), "by_source", "id").drop("by_source"),
        "grouped",
    )


def _medians(rows: DataFrame) -> DataFrame:
    """For each group the median of every coordinate, as the centre of a first estimate."""
    values = rows.select(
        "group", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(DIMS)])).alias("dim", "x")
    )
    counts = values.groupBy("group", "dim", "x").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("group", "dim").orderBy("x")
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("group", "dim")))
    middle = upto.where("2 * upto >= all").groupBy("group", "dim").agg(F.min("x").alias("x"), F.first("all").alias("all"))
    centre = [F.max(F.when(F.col("dim") == i, F.col("x"))).cast("double").alias(f"m{i}") for i in range(DIMS)]
    spread = [
        F.lit(FLOORS[i] * SCALE if i == j else 0.0).alias(f"l{i}{j}") for i, j in _pairs()
    ]  # the least spread: distances from the medians in floors
    return middle.groupBy("group").agg(F.max("all").alias("n"), *centre).where(F.col("n") >= MIN_GROUP).select("*", *spread)


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the squared distance ``d2`` to their group's centre, null without an estimate."""
    found = lookup_join(rows, estimates.drop("n"), "group", "id")
    total = F.lit(0.0)
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        found = found.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return found.withColumn("d2", total).select(*rows.columns, "d2")


def _factored(moments: DataFrame) -> DataFrame:
    """Centres and Cholesky factors of the covariances, from counts, sums and sums of products."""
    out = moments
    for i in range(DIMS):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("k"))
    for i, j in _pairs():
        floor = (FLOORS[i] * SCALE) ** 2 if i == j else 0.0
        spread = F.col(f"p{i}{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}")
        rest = spread * HALF_FACTOR + floor
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # the sum of a covariance and positive floors: the root is of a positive number
        out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("group", "n", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _pairs()])


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates of the half of each group that is nearest by the given ones."""
    bin_of = F.least(F.floor(F.sqrt("d2") * BINS), F.lit(BINS * FAR)).cast("int")
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _pairs()]
    bins = (
        _distance(rows, estimates).where("d2 IS NOT NULL").groupBy("group", bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("k"), *sums)
    )
    # at most BINS * FAR + 1 rows a group from here on
    before = W.partitionBy("group").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    ranked = bins.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn(
        "n", F.sum("k").over(W.partitionBy("group"))
    )
    near = ranked.where(2 * F.col("before") < F.col("n") + DIMS + 1)
    names = [f"s{i}" for i in range(DIMS)] + [f"p{i}{j}" for i, j in _pairs()]
    return _factored(near.groupBy("group").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ["k", *names]]))


def outlier_distances(rows: DataFrame, stage: Staging, steps: int = STEPS) -> DataFrame:
    """Rows (id, lang, source and the statistics) with ``d2``, their squared robust distance.

    Null where no group of ``MIN_GROUP`` rows was found. Groups with fewer rows are put together by
    language, and those of languages with fewer altogether into one.
    """
    vectors = stage.write(_grouped(rows.select("*", *_vector()), stage), "vectors")
    estimates = stage.write(_medians(vectors), "medians")
    for _ in range(steps):
        estimates = stage.write(_concentrated(vectors, estimates), "estimates")
    return _distance(vectors, estimates).drop("group", *[f"x{i}" for i in range(DIMS)])


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    steps: int = STEPS,
) -> DataFrame:
    """One row per row of ``docs``: id, lang, source, the statistics, base_failed, d2, kept.

    A document fails the base rules with fewer than 20 words, or with more than 30 % of its words
    in repeated windows. It is kept if it passes them and its squared distance ``d2`` is at most
    ``CUT``, or unknown because its group is too small. Null texts have no words and fail.
    Null languages and sources are groups like any other. Rows that share an id are judged one by
    one, equal texts of a group alike. Empty and very long texts are read whole. Other columns of
    ``docs`` are not read; an empty table gives an empty result.
    """
    found = text_statistics(F.col(f"`{text_col}`"))
    with Staging(docs.sparkSession, "quality") as stage:
        read = stage.write(
            docs.select(
                F.col(f"`{id_col}`").alias("id"),
                F.col(f"`{lang_col}`").cast("string").alias("lang"),
                F.col(f"`{source_col}`").cast("string").alias("source"),
                *[column.alias(name) for name, column in found.items()],
            ),
            "statistics",
        )
        base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        rows = read.select("id", "lang", "source", "words.*", "lines.*", "n_symbols").withColumn("base_failed", base)
        passed = outlier_distances(rows.where("NOT base_failed"), stage, steps)
        failed = rows.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
        kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUT)
        return written(passed.unionByName(failed).withColumn("kept", kept), "quality-rules")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics and whether it is kept."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


_PAIR_NAMES = [(i, j) for i in range(4) for j in range(i + 1)]


def _step_sql(n: int) -> str:
    """The SQL of a concentration step: distances, bins, the nearest half, its moments, their factor."""
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in range(4)] + [f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in _PAIR_NAMES])
    again = ", ".join([f"sum(s{i}) / sum(k) AS m{i}" for i in range(4)])
    spread = ", ".join(
        f"(sum(p{i}{j}) / sum(k) - (sum(s{i}) / sum(k)) * (sum(s{j}) / sum(k))) * 2.109::DOUBLE"
        + (f" + {(FLOORS[i] * 512) ** 2!r}::DOUBLE" if i == j else "")
        + f" AS c{i}{j}"
        for i, j in _PAIR_NAMES
    )
    return f"""
, bins{n} AS MATERIALIZED (
  SELECT g, least(floor(sqrt(d2) * 64), 4096) AS bin, count(*) AS k, {sums} FROM far{n} GROUP BY ALL
), ranked{n} AS (
  SELECT *, coalesce(sum(k) OVER (PARTITION BY g ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(k) OVER (PARTITION BY g) AS n
  FROM bins{n}
), spread{n} AS (SELECT g, {again}, {spread} FROM ranked{n} WHERE 2 * before < n + 5 GROUP BY g
), f0{n} AS (SELECT *, sqrt(c00) AS l00 FROM spread{n}
), f1{n} AS (SELECT *, c10 / l00 AS l10, c20 / l00 AS l20, c30 / l00 AS l30 FROM f0{n}
), f2{n} AS (SELECT *, sqrt(c11 - l10 * l10) AS l11 FROM f1{n}
), f3{n} AS (SELECT *, (c21 - l20 * l10) / l11 AS l21, (c31 - l30 * l10) / l11 AS l31 FROM f2{n}
), f4{n} AS (SELECT *, sqrt(c22 - l20 * l20 - l21 * l21) AS l22 FROM f3{n}
), f5{n} AS (SELECT *, (c32 - l30 * l20 - l31 * l21) / l22 AS l32 FROM f4{n}
), estimate{n + 1} AS MATERIALIZED (SELECT *, sqrt(c33 - l30 * l30 - l31 * l31 - l32 * l32) AS l33 FROM f5{n})
{_far_sql(n + 1)}"""


def _far_sql(n: int) -> str:
    return f"""
, a{n} AS (SELECT v.*, e.* EXCLUDE (g), (x0 - m0) / l00 AS z0 FROM vectors v JOIN estimate{n} e USING (g)
), b{n} AS (SELECT *, (x1 - m1 - l10 * z0) / l11 AS z1 FROM a{n}
), c{n} AS (SELECT *, (x2 - m2 - l20 * z0 - l21 * z1) / l22 AS z2 FROM b{n}
), d{n} AS (SELECT *, (x3 - m3 - l30 * z0 - l31 * z1 - l32 * z2) / l33 AS z3 FROM c{n}
), far{n} AS MATERIALIZED (SELECT doc_id, g, x0, x1, x2, x3, z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3 AS d2 FROM d{n})"""


OP13_SQL = (
    r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 7]) AS times FROM starts
), covered AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM windows WHERE times > 1
), repeats AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n FROM covered GROUP BY doc_id
), lined AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words
), stats AS MATERIALIZED (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words d JOIN lined USING (doc_id) LEFT JOIN repeats USING (doc_id)
), based AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM based WHERE NOT base_failed
), leveled AS (
  SELECT *, sum(CASE WHEN n < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS m FROM counted
), vectors AS MATERIALIZED (
  SELECT doc_id,
         CASE WHEN n >= 50 THEN {'a': 2, 'b': lang, 'c': source} WHEN m >= 50 THEN {'a': 1, 'b': lang, 'c': NULL}
              ELSE {'a': 0, 'b': NULL, 'c': NULL} END::STRUCT(a INTEGER, b VARCHAR, c VARCHAR)::VARCHAR AS g,
         CAST(floor(sqrt(word_chars / n_words) * 512 + 0.5) AS BIGINT) AS x0,
         CAST(floor(sqrt(n_symbols / word_chars) * 512 + 0.5) AS BIGINT) AS x1,
         CAST(floor(sqrt(n_dup_lines / n_lines) * 512 + 0.5) AS BIGINT) AS x2,
         CAST(floor(sqrt(n_repeat_words / n_words) * 512 + 0.5) AS BIGINT) AS x3
  FROM leveled
), estimate0 AS MATERIALIZED (
  SELECT g, CAST(quantile_disc(x0, 0.5) AS DOUBLE) AS m0, CAST(quantile_disc(x1, 0.5) AS DOUBLE) AS m1,
         CAST(quantile_disc(x2, 0.5) AS DOUBLE) AS m2, CAST(quantile_disc(x3, 0.5) AS DOUBLE) AS m3,
         40.96::DOUBLE AS l00, 0.0::DOUBLE AS l10, 25.6::DOUBLE AS l11, 0.0::DOUBLE AS l20, 0.0::DOUBLE AS l21,
         76.8::DOUBLE AS l22, 0.0::DOUBLE AS l30, 0.0::DOUBLE AS l31, 0.0::DOUBLE AS l32, 76.8::DOUBLE AS l33
  FROM vectors GROUP BY g HAVING count(*) >= 50
)"""
    + _far_sql(0)
    + "".join(_step_sql(n) for n in range(STEPS))
    + f"""
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(d2, 0) <= 23.51 AS kept
FROM based b LEFT JOIN far{STEPS} USING (doc_id)
"""
)
