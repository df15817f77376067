"""Choice of the schema file of each database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_path


def list_schema_files(spark: SparkSession, root: str) -> DataFrame:
    """The ``*.sql`` files under ``<root>/database/<db_id>/``: (db_id, file_name, path)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.sql")
        .load(f"{root.rstrip('/')}/database/*/*.sql")
        .select(F.col("_metadata.file_path").alias("path"))
    )
    parts = F.split(file_path(F.col("path")), "/")
    return files.select(
        F.element_at(parts, -2).alias("db_id"), F.element_at(parts, -1).alias("file_name"), "path"
    )


def resolve_schema_files(files: DataFrame) -> DataFrame:
    """One file per database: ``schema.sql``, else ``<db_id>.sql``, else the first ``*.sql``.

    ``min_by`` combines on the map side, so a database with very many files costs
    its reducer one row per map task.
    """
    rank = (
        F.when(F.col("file_name") == "schema.sql", 0)
        .when(F.col("file_name") == F.concat("db_id", F.lit(".sql")), 1)
        .otherwise(2)
    )
    others = [c for c in files.columns if c != "db_id"]
    return (
        files.where(F.col("file_name").endswith(".sql"))
        .groupBy("db_id")
        .agg(F.min(F.struct(rank.alias("rank"), "file_name", *[c for c in others if c != "file_name"])).alias("best"))
        .select("db_id", *[F.col(f"best.{c}").alias(c) for c in others])
    )
