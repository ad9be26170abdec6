"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from clausework.operators.lineage import materialise, release
from clausework.operators.skew import skew_join

# vertices that a task holds before it writes out what it has joined so far
CONTRACT_VERTICES = 1_000_000
# edges that a task contracts; a graph with fewer is one task's work and needs no rounds
EDGES_PER_TASK = 100_000


def _is_star_forest(edges: DataFrame, keys: list[str]) -> bool:
    """True when every child has one parent and no parent is a child."""
    ends = edges.select(*keys, F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(*keys, F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    roles = ends.groupBy(*keys, "v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the edges that a task holds by a star forest with the same components.

    No shuffle: it shortens paths and drops redundant edges before each round. A task holds a bounded number of
    vertices; what it could not see together is left to the rounds.
    """
    arrow = to_arrow_schema(edges.select(*keys, "a", "b").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(v):
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = v = parent[up]  # halve the path
            return v

        def stars() -> pa.RecordBatch:
            rows = [(*v, find(v)[-1]) for v in list(parent) if parent[v] != v]
            columns = zip(*rows) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for *key, a, b in zip(*(batch.column(f.name).to_pylist() for f in arrow)):
                left, right = find((*key, a)), find((*key, b))
                if left != right:
                    parent[max(left, right)] = min(left, right)
            if len(parent) > CONTRACT_VERTICES:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select(*keys, "a", "b").mapInArrow(run, edges.select(*keys, "a", "b").schema)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it.

    Only vertices with a smaller neighbour change anything, and those are the children ``a`` of some edge. The
    edges are joined on their parent, which may be a hub, so hot parents are split.
    """
    lowest = edges.groupBy(*keys, F.col("a").alias("b")).agg(F.min("b").alias("low"))
    moved = skew_join(edges, lowest, [*keys, "b"], "left", salt_by=["a"])
    return moved.select(*keys, "a", F.coalesce("low", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy(*keys, "a").agg(F.min("b").alias("low"))
    joined = edges.join(lowest, [*keys, "a"])
    down = joined.where(F.col("b") != F.col("low")).select(*keys, F.col("b").alias("a"), F.col("low").alias("b"))
    return lowest.select(*keys, "a", F.col("low").alias("b")).unionByName(down).distinct()


def connected_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, root``: the smallest vertex of each vertex's component.

    ``edges`` has ``a > b`` within ``keys``. Roots have no row of their own. The number of rounds grows with the
    logarithm of the number of vertices; every round is a table, so nothing is recomputed after a loss. Tasks are as many
    as the edges fill: what one task has contracted whole is a star forest already.
    """
    per_task = max(1, min(EDGES_PER_TASK, CONTRACT_VERTICES // 2))  # so many edges never pass the bound on vertices

    def contracted(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
        tasks = max(1, ceil(most / per_task))
        return materialise(_contract(rows.coalesce(tasks), keys), "components"), tasks

    given = materialise(edges.select(*keys, "a", "b").distinct(), "components")
    stars, tasks = contracted(given, given.count())
    release(given)
    while tasks > 1 and not _is_star_forest(stars, keys):
        large = materialise(_large_star(stars, keys), "components")
        release(stars)
        stars, tasks = contracted(_small_star(large, keys), large.count())
        release(large)
    return stars.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
