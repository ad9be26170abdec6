"""The totals over all stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.operators import paragraphs as P
from clausework.operators import sites as S


def _long(row: DataFrame, prefix: str) -> DataFrame:
    """A one-row frame as ``metric, value`` rows."""
    entries = F.array(
        *[F.struct(F.lit(f"{prefix}{c}").alias("metric"), F.col(c).cast("long").alias("value")) for c in row.columns]
    )
    return row.select(F.explode(entries).alias("e")).select("e.metric", "e.value")


def report(chunk_counts: DataFrame, ranges: DataFrame, policy_pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``metric, value``: funnel totals, list range, policy page counts and dataset sizes."""
    parts = [
        _long(S.funnel_totals(chunk_counts), ""),
        _long(S.range_bounds(ranges), "list_"),
        _long(S.policy_page_counts(policy_pages), "policy_"),
        _long(P.dataset_totals(paragraphs), "dataset_"),
    ]
    return reduce(DataFrame.unionByName, parts)
