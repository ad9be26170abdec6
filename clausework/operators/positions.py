"""Row positions, slices, chunks, samples and representatives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.operators.lineage import materialise
from clausework.operators.skew import skew_join

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _columns(names: list[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def row_position(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position of every row in the total order ``order``.

    A range sort numbers the rows inside each partition; the sorted rows are written as a table, so
    that the numbers hold whatever is recomputed later. The partitions' sizes then give each its offset.
    No task sees more than its own range. Only the offsets (one row per partition) are broadcast.
    """
    numbered = df.orderBy(*_columns(order)).withColumn("_row", F.monotonically_increasing_id())
    stored = materialise(
        numbered.withColumn("_part", F.shiftright("_row", _ROW_BITS)).withColumn(
            "_row", F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
        ),
        "positions",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def rank_slice(df: DataFrame, start: int, end: int, rank: str = "rank") -> DataFrame:
    """Rows ``start`` to ``end`` (half open, 0-based) of a list whose ranks are 1, 2, 3, …: a pushed filter."""
    return df.where((F.col(rank) > start) & (F.col(rank) <= end))


def position_slice(df: DataFrame, order: list[str | Column], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (half open) in any total order."""
    return row_position(df, order, "_pos").where(F.col("_pos").between(start, end - 1)).drop("_pos")


def first_n(df: DataFrame, n: int = 10) -> DataFrame:
    """Any first ``n`` rows, for a look at the data."""
    return df.limit(n)


def assign_splits(df: DataFrame, site: str = "url", sites_per_split: int = 2100) -> DataFrame:
    """Add ``split``: sites in name order, ``sites_per_split`` to a split.

    Positions are given to the distinct sites, not to the rows. ``df`` is read several times, so it should be a table.
    """
    sites = row_position(df.select(site).distinct(), [site], "_site_pos").select(
        site, F.floor(F.col("_site_pos") / sites_per_split).cast("int").alias("split")
    )
    return skew_join(df, sites, [site])


def chunk_of(df: DataFrame, order: list[str | Column], size: int = 100) -> DataFrame:
    """Add ``pos`` and ``chunk``: consecutive runs of ``size`` rows."""
    return row_position(df, order).withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))


def assign_chunks(df: DataFrame, order: list[str | Column], num_chunks: int = 10, within: list[str] = ()) -> DataFrame:
    """Add ``pos`` and ``chunk``: ``num_chunks`` slices of ``ceil(rows / num_chunks)`` rows, the last one short.

    ``within`` names groups that are each sliced on their own; positions then count from the group's first row. Both come
    from one global order, so no group is sorted in a single task.
    """
    within = list(within)
    placed = row_position(df, [*within, *order])
    if not within:
        size = max(1, math.ceil(placed.count() / num_chunks))
        return placed.withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))
    groups = placed.groupBy(*within).agg(F.min("pos").alias("_first"), F.ceil(F.count("*") / num_chunks).alias("_size"))
    joined = skew_join(placed, groups, within, salt_by=["pos"]).withColumn("pos", F.col("pos") - F.col("_first"))
    return joined.withColumn("chunk", F.floor(F.col("pos") / F.col("_size")).cast("int")).drop("_first", "_size")


def sample_members(df: DataFrame, group: list[str], member: str, k: int = 20, seed: int = 0) -> DataFrame:
    """At most ``k`` rows of each group, uniformly by a seeded hash of ``member``; repeatable.

    The rank filter is applied inside every map task first (WindowGroupLimit), so at most ``k`` rows of
    a group leave a task, however large the group. Spark does this for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000).
    """
    by_hash = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(member))), member)
    return df.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= k).drop("_rank")


def latest_wins(df: DataFrame, key: list[str], order: list[str], row_id: str) -> DataFrame:
    """One row per key: the last in ``order``. ``row_id`` is unique.

    Winners are found on the narrow columns; the wide ones (page text) only meet the winners.
    """
    ranked = F.struct(*order, F.col(row_id).alias("_id"))
    last = df.groupBy(*key).agg(F.max(ranked).alias("_last"))
    return df.join(last.select(F.col("_last._id").alias(row_id)), row_id, "left_semi")
