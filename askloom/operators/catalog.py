"""Schema documents: one per CREATE TABLE, kept per database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ddl import normalize_ddl, statement_kind, table_name
from ..functions.prompts import GENERATION_SEPARATOR
from ..functions.text import file_path
from ..storage import read_or_empty, written

SCHEMA_DOCS = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("doc_no", T.IntegerType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc", T.StringType()),
    ]
)
STORED_DOCS = T.StructType([*SCHEMA_DOCS.fields, T.StructField("bucket", T.IntegerType())])

# Databases are kept in this many folders, by a hash of their id: a folder for each
# would mean as many files as databases. It must not change once a store exists.
BUCKETS = 64


def file_stem(path: Column) -> Column:
    """The file name without its extension: the default name of a database."""
    name = F.element_at(F.split(file_path(path), "/"), -1)
    return F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")


def schema_docs(statements: DataFrame, db_id: Column | None = None) -> DataFrame:
    """(db_id, doc_no, doc_id, doc) from the CREATE TABLE statements of dumps.

    Numbers follow the order of the statements. The window holds one database's
    table declarations, the same text that ends up in each of its prompts. Rewriting a
    declaration costs far more than moving it, so they are dealt out first: the files they
    come from may be few, and small.
    """
    db_id = file_stem(F.col("path")) if db_id is None else db_id
    found = statements.where(statement_kind(F.col("stmt")) == "create_table").select(
        db_id.alias("db_id"), "path", "stmt_no", "part_no", "stmt"
    )
    tables = found.repartition("path", "stmt_no", "part_no").select(
        "db_id", "path", "stmt_no", "part_no", normalize_ddl(F.concat("stmt", F.lit(";"))).alias("doc")
    )
    order = W.partitionBy("db_id").orderBy("path", "stmt_no", "part_no")
    numbered = tables.withColumn("doc_no", F.row_number().over(order) - 1)
    return numbered.select(
        "db_id", "doc_no", F.concat(F.lit("schema_doc_"), F.col("doc_no")).alias("doc_id"), "doc"
    )


def list_tables(statements: DataFrame, db_id: Column | None = None) -> DataFrame:
    """(db_id, table_name) declared in dumps."""
    db_id = file_stem(F.col("path")) if db_id is None else db_id
    return (
        statements.where(statement_kind(F.col("stmt")) == "create_table")
        .select(db_id.alias("db_id"), table_name(F.col("stmt")).alias("table_name"))
        .distinct()
    )


def list_views(spark: SparkSession) -> list[str]:
    """Names of the tables that queries of this session can use."""
    return sorted(t.name for t in spark.catalog.listTables())


def _bucket(db_id: Column) -> Column:
    return F.pmod(F.xxhash64(db_id), F.lit(BUCKETS)).cast("int")


def read_schema_docs(spark: SparkSession, path: str, db_id: str | None = None) -> DataFrame:
    """All documents, or those of one database; an empty table before the first store.

    One database's folder is known from its id, and within it files and row groups
    are sorted by database, so that most of the store is never read.
    """
    docs = read_or_empty(spark, path, STORED_DOCS)
    if db_id is not None:
        docs = docs.where((F.col("bucket") == _bucket(F.lit(db_id))) & (F.col("db_id") == db_id))
    return docs.select(SCHEMA_DOCS.fieldNames())


def store_schema_docs(docs: DataFrame, path: str, refresh: bool = False) -> None:
    """Write documents once per database; ``refresh`` replaces those of the given databases.

    Databases that already have documents are skipped, even when the new ones differ.
    A refresh writes the buckets of the given databases anew, with the other
    databases in them as they are. The rebalance hint gathers each bucket into few
    files and splits one that is too big.
    """
    spark = docs.sparkSession
    docs = docs.select(SCHEMA_DOCS.fieldNames()).withColumn("bucket", _bucket(F.col("db_id")))
    stored = read_or_empty(spark, path, STORED_DOCS)
    if refresh:
        docs = written(docs, "new-schema-docs")
        others = stored.join(docs.select("bucket").distinct(), "bucket", "left_semi").join(
            docs.select("db_id").distinct(), "db_id", "left_anti"
        )
        docs = written(docs.unionByName(others), "all-schema-docs")
    else:
        docs = docs.join(stored.select("db_id").distinct(), "db_id", "left_anti")
    (
        docs.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "db_id", "doc_no")
        .write.mode("overwrite" if refresh else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def schema_text_by_db(docs: DataFrame, separator: str = GENERATION_SEPARATOR) -> DataFrame:
    """(db_id, schema_text): the documents of each database in order."""
    ordered = F.array_sort(F.collect_list(F.struct("doc_no", "doc")))
    return docs.groupBy("db_id").agg(F.array_join(ordered["doc"], separator).alias("schema_text"))


def store_count_check(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(db_id, n_expected, n_stored, ok) for each database of either side."""

    def counts(docs: DataFrame, name: str) -> DataFrame:
        return docs.groupBy("db_id").agg(F.count(F.lit(1)).alias(name))

    both = counts(expected, "n_expected").join(counts(stored, "n_stored"), "db_id", "full")
    return both.fillna(0, ["n_expected", "n_stored"]).withColumn(
        "ok", F.col("n_expected") == F.col("n_stored")
    )


def verify_store(expected: DataFrame, stored: DataFrame) -> None:
    """Fail if any database holds another number of documents than was sent."""
    wrong = store_count_check(expected, stored).where(~F.col("ok")).orderBy("db_id").first()
    if wrong is not None:
        raise ValueError(
            f"Database {wrong['db_id']!r} should have {wrong['n_expected']} stored documents "
            f"and has {wrong['n_stored']}."
        )
