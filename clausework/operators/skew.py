"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is looked at when it may hold more than this share of the rows: the sketch has 1 / SHARE counters.
SHARE = 0.001
# rows of one key that a task should take; a key with more is split into as many sub-keys as it fills tasks
ROWS_PER_TASK = 100_000


def _hot(fact: DataFrame, key: Column, rows_per_task: int) -> dict[int, int]:
    """Key hash to number of sub-keys. A frequent-items sketch names the candidates, then those alone are counted."""
    hashed = fact.select(key.alias("h"))
    maybe = hashed.stat.freqItems(["h"], SHARE).first()[0]
    if not maybe:
        return {}
    counts = hashed.where(F.col("h").isin(list(maybe))).groupBy("h").count().where(F.col("count") > rows_per_task)
    return {r["h"]: ceil(r["count"] / rows_per_task) for r in counts.collect()}  # fewer than 1 / SHARE rows


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: list[str] | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Join ``fact`` with ``dim`` on ``on`` (inner, left, left_semi or left_anti), splitting hot keys.

    Rows of a hot key are spread over sub-keys by a hash of ``salt_by``, else of the other columns; the hot rows of ``dim``
    are copied to each sub-key. A fact of key columns only has nothing to hash, so its rows are spread by their number.
    ``fact`` is scanned once more for its keys, in a narrow pass, so it should be a table rather than a long lineage.
    """
    key = F.xxhash64(*on)
    hot = _hot(fact, key, ROWS_PER_TASK if rows_per_task is None else rows_per_task)
    if not hot:
        return fact.join(dim, on, how)
    salts: Column = reduce(lambda c, h: c.when(key == h, hot[h]), hot, F.when(F.lit(False), 1)).otherwise(1)
    spread = salt_by or [c for c in fact.columns if c not in on]
    place = F.xxhash64(*spread) if spread else F.monotonically_increasing_id()
    salted_fact = fact.withColumn("_salt", F.pmod(place, salts.cast("long")).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted_fact.join(salted_dim, [*on, "_salt"], how).drop("_salt")
