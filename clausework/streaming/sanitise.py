"""Sanitising page files as they arrive, and skipping finished work in batch jobs.

Both write through ``write_batch``: a batch has a folder of its own, named by its id, and counts once Spark has put its
success marker there. A batch that is run again after a stop replaces its own folder, so nothing is lost or doubled.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clausework.operators.links import not_collected
from clausework.operators.paragraphs import sanitise_pages
from clausework.sources.readers import page_path_columns

MARKER = "_SUCCESS"
# up to so many files of a micro-batch are looked up by the driver, which takes less time than a job for them
LISTED_FILES = 1000
THRESHOLD = "spark.sql.sources.parallelPartitionDiscovery.threshold"


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_batch(rows: DataFrame, out: str, batch: str) -> None:
    """Write ``rows`` as the parquet folder ``out/batch=<batch>``, replacing what an earlier try left there."""
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(f"{out}/batch={batch}")


def committed(spark: SparkSession, out: str) -> list[str]:
    """Ids of the batches below ``out`` that were written whole."""
    files, place = _folder(spark, out)
    if not files.exists(place):
        return []
    jvm = spark.sparkContext._jvm
    found = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), MARKER)):
            found.append(name.removeprefix("batch="))
    return sorted(found)


def forget(spark: SparkSession, out: str, batch: str) -> None:
    """Take a batch out of what counts; its files are replaced when it is run again."""
    files, place = _folder(spark, f"{out}/batch={batch}/{MARKER}")
    files.delete(place, False)


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows of all whole batches below ``out``; an unfinished one is not read."""
    paths = [f"{out}/batch={b}" for b in committed(spark, out)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def incremental(
    job: Callable[[DataFrame], DataFrame], inputs: DataFrame, out: str, key: list[str], batch: str, schema: T.StructType
) -> DataFrame:
    """Run ``job`` on the inputs that no batch below ``out`` has finished, append its rows as ``batch``, and return all rows.

    ``key`` names columns of the inputs that the job's rows have as well; ``schema`` is that of the job's rows. What an
    input gave no row for is tried again. Running a batch again does it anew, against the other batches.
    """
    spark = inputs.sparkSession
    others = [f"{out}/batch={b}" for b in committed(spark, out) if b != batch]
    done = spark.read.schema(schema).parquet(*others) if others else spark.createDataFrame([], schema)
    write_batch(job(not_collected(inputs, done.select(*key).distinct(), key)), out, batch)
    return read_batches(spark, out, schema)


@contextmanager
def _listing(spark: SparkSession, max_files: int) -> Iterator[None]:
    """Streams that start in here look up the files of a small micro-batch without a job."""
    before = spark.conf.get(THRESHOLD)
    if max_files <= LISTED_FILES:
        spark.conf.set(THRESHOLD, str(max(int(before), max_files)))
    try:
        yield
    finally:
        spark.conf.set(THRESHOLD, before)


def lane_globs(lanes: int) -> list[str]:
    """Patterns of file names, by their last characters: every name fits exactly one, the first if it ends in no letter or digit."""
    letters = string.digits + string.ascii_letters
    if not 1 <= lanes <= len(letters):
        raise ValueError(f"from 1 to {len(letters)} lanes")
    others = "".join(c for i, c in enumerate(letters) if i % lanes)
    return [f"*[!{others}]" if others else "*", *(f"*[{letters[k::lanes]}]" for k in range(1, lanes))]


def page_stream(spark: SparkSession, path: str, max_files: int = 10_000, names: str = "*") -> DataFrame:
    """``url, page_id, html`` of page files as they appear under ``path``, with file names that fit the pattern ``names``."""
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", names)
        .load(path)
    )
    site, name = page_path_columns()
    return files.select(site.alias("url"), name.alias("page_id"), F.col("value").alias("html"))


def write_stream(
    rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, prefix: str = ""
) -> StreamingQuery:
    """Append a stream to the batches below ``out``: everything available now, each input file once.

    ``transform`` runs on every micro-batch as a plain table. The checkpoint names the batches: one that was written but
    not yet checked off is written again under its own id. Streams that share ``out`` need a ``prefix`` each.
    """

    def append(batch: DataFrame, number: int) -> None:
        write_batch(transform(batch) if transform else batch, out, f"{prefix}{number:012d}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sanitise_stream(
    spark: SparkSession, path: str, out: str, checkpoint: str, n: int = 10, max_files: int = 10_000
) -> StreamingQuery:
    """Sanitised paragraphs of all page files not seen before, appended to the batches below ``out``.

    Deduplication is per page and a page is one row, so batches know nothing of each other, and the columns are laid out
    once for all batches.
    """
    with _listing(spark, max_files):
        return write_stream(sanitise_pages(page_stream(spark, path, max_files), n=n), out, checkpoint)


def sanitise_lanes(
    spark: SparkSession, path: str, out: str, checkpoint: str, n: int = 10, max_files: int = 10_000, lanes: int = 4
) -> None:
    """``sanitise_stream`` in several streams at once, until all files are done.

    Much of a small micro-batch is the driver's own work, in which the cores wait. Each file is one lane's by its name, and a
    lane has its own checkpoint and batches of up to ``max_files``. The number of lanes stays with a checkpoint.
    """
    with _listing(spark, max_files):
        running = [
            write_stream(sanitise_pages(page_stream(spark, path, max_files, names), n=n), out, f"{checkpoint}/{lanes}-{k}", prefix=f"{lanes}-{k}-")
            for k, names in enumerate(lane_globs(lanes))
        ]
    try:
        for lane in running:
            lane.awaitTermination()
    finally:
        for lane in running:
            lane.stop()
