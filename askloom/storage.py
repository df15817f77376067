"""Where intermediate tables go, and the check made before a broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from types import TracebackType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one below the warehouse.

    A cluster must name one of the two: the warehouse's default is a folder of the
    driver's machine, which only a local master may use.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local") or context.getConf().contains("spark.sql.warehouse.dir"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/askloom-staging"
    raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")


_open_sweeps: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for names in _open_sweeps:
        names.append(folder)
    return folder


@contextmanager
def swept(spark: SparkSession, keep: Iterable[str] = ()) -> Iterator[None]:
    """Delete at the end every folder that jobs inside have named by ``new_folder``, but ``keep``.

    For a caller who has written what it needs: tables that a job returns unread lie there too.
    """
    names: list[str] = []
    _open_sweeps.append(names)
    try:
        yield
    finally:
        _open_sweeps[:] = [x for x in _open_sweeps if x is not names]
        for folder in set(names) - set(keep):
            remove_folder(spark, folder)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that later plans start from the files.

    Cuts the lineage, survives lost executors, and lets several readers each take
    only the columns they need.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job has made, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Staging:
    """Intermediate tables of one job, below one folder that goes when the job ends.

    What the job returns must not read them: write it with ``written`` first.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, new_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.path(name))

    def __enter__(self) -> Staging:
        return self

    def __exit__(
        self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None
    ) -> None:
        remove_folder(self.spark, self.folder)


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType | str, **options: str
) -> DataFrame:
    """The Parquet table at ``path``, empty if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def size_in_bytes(df: DataFrame) -> int:
    """Exact number of bytes that the columns of ``df`` hold as text."""
    row = F.lit(0).cast("long")
    for field in df.schema.fields:
        row = row + F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0)) + 8
    return df.select(F.sum(row).alias("n")).first()["n"] or 0


def small_enough(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return size_in_bytes(df) <= limit


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has been measured to be small, else as it is."""
    return F.broadcast(df) if small_enough(df) else df
