"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A URL is expanded into every (host suffix, path prefix) that a rule could name. The
expressions meet the rules in an equi-join on the first four bytes of their SHA-256; the
full digest then confirms the match, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Staging, small_enough, written

PREFIX_HEX = 8  # four bytes
RULES_BROADCAST_BYTES = 8 * 1024 * 1024
SEPARATOR = "\x00"  # between host and path in what is hashed: in neither of them

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(SEPARATOR), path), 256)


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and what follows each of its dots, of these the last ones of up to ``most`` labels:
    a rule with fewer labels fits no longer suffix, so that hosts of any length are cheap."""
    parts = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.greatest(F.size(parts) - most + 1, F.lit(1)), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )


def judge_urls(
    urls: DataFrame, rules: DataFrame, default: str = "allow", broadcast_bytes: int = RULES_BROADCAST_BYTES
) -> DataFrame:
    """Distinct urls (column ``url``) with host, path, rule, verdict.

    ``rules`` has host, path, verdict; a rule fits its host and all subdomains of it when
    the path of the url starts with the rule's. The longest rule (host and path together)
    wins, then the longer host, then ``block`` before ``allow``. Without a rule the verdict
    is ``default``: an address on no list passes. A null url, or one without ``://``, has an
    empty host and path. Rules with null parts fit nothing; repeated rules count once. Only
    path lengths that rules of that length have are expanded: their list is at most as long as
    the longest path of a rule; and only host suffixes of as many labels as a rule's host has at most.
    Hosts and paths may be of any length.
    """
    rules = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path"), F.col("verdict")
    ).dropna().distinct()
    keyed = rules.withColumn("full", digest(F.col("host"), F.col("path"))).select(
        F.substring("full", 1, PREFIX_HEX).alias("short"),
        "full",
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            F.col("verdict").alias("verdict"),
            F.concat("host", "path").alias("rule"),
        ).alias("match"),
    )
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    most = rules.agg(F.max(labels_of(F.col("host")))).first()[0] or 1
    known = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    expressions = (
        known.withColumn("suffix", F.explode(host_suffixes(F.col("host"), most)))
        .withColumn("cut", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
        .where(F.col("cut") <= F.length("path"))
        .select("url", digest(F.col("suffix"), F.expr("left(path, cut)")).alias("full"))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
    )
    side = F.broadcast(keyed) if small_enough(keyed.drop("match"), broadcast_bytes) else keyed
    candidates = expressions.join(side.withColumnRenamed("full", "rule_full"), "short")
    confirmed = candidates.where("full = rule_full")
    best = confirmed.groupBy("url").agg(F.max("match").alias("match"))
    same = F.col("k.url").eqNullSafe(F.col("b.url"))
    return known.alias("k").join(best.alias("b"), same, "left").select(
        "k.url",
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce(F.col("match.verdict"), F.lit(default)).alias("verdict"),
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: id, url, host, path, rule, verdict.

    Each distinct url is judged once, so a url on many rows costs no more than another.
    Other columns of ``pages`` are not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    with Staging(pages.sparkSession, "url-filter") as stage:
        judged = stage.write(judge_urls(rows, rules, default), "judged")
        same = F.col("r.url").eqNullSafe(F.col("j.url"))
        return written(
            rows.alias("r").join(judged.alias("j"), same, "left").select("r.id", "r.url", "j.host", "j.path", "j.rule", "j.verdict"),
            "url-verdicts",
        )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
       (SELECT r.host || r.path FROM rules r
        WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
        ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.verdict FROM rules r
        WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
        ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC LIMIT 1), 'allow') AS verdict
FROM parts p
"""
