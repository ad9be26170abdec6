"""Stage tables: written once to shared storage, so a lost executor costs no recomputation."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


# a shuffle's files are deleted as soon as the table that it served is written
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()  # lists of the tables that settle() calls of this thread have seen written


def scratch_root(spark: SparkSession) -> str:
    """The folder for stage tables: the session's checkpoint folder, else one in the warehouse.

    Executors share both. A warehouse on the driver's own disk is refused unless the session runs there alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/stages"


def _job_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/clausework/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a parquet table in the scratch folder and return a reader of it.

    Unlike a row checkpoint the table keeps column pruning, pushed filters and size statistics. A file is read by one task, if
    it is not very large: ``rows_per_file`` above 0 bounds what a task of slow work per row gets.
    """
    spark = df.sparkSession
    path = f"{_job_folder(spark)}/{label}-{uuid4().hex}"
    with short_shuffles(spark):
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    for seen in getattr(_open, "seen", []):
        seen.append(table)
    return table


def _delete(tables: list[DataFrame]) -> None:
    for table in tables:
        spark, path = table.sparkSession, table.stage_path
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, when all that read them has been written."""
    _delete(list(tables))


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def passing_stages() -> Iterator[list[DataFrame]]:
    """Stage tables that are written in here are deleted at its end, but for those taken from the list that it gives."""
    if not hasattr(_open, "seen"):
        _open.seen = []
    written: list[DataFrame] = []
    _open.seen.append(written)
    try:
        yield written
    finally:
        _open.seen = [seen for seen in _open.seen if seen is not written]
    _delete(written)


def settle(build: Callable[[], DataFrame], label: str, rows_per_file: int = 0) -> DataFrame:
    """``materialise(build())``, without the stage tables that ``build`` has written on its way."""
    with passing_stages() as written:
        table = materialise(build(), label, rows_per_file)
        written.pop()  # the table itself
    return table


def drop_stages(spark: SparkSession) -> None:
    """Delete all stage tables of this application; results that still read them must have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_job_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
