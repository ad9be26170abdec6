"""Mixing to target weights: rake cell token counts to marginals, then sample documents by calibrated probability.

Column functions only. Raking runs on the table of cells (one row per source, language and topic), which is written
after every round, so neither the lineage nor the work per round grows with the documents. Marginals are summed with
map-side partials and joined back; Spark copies them to the tasks only while they are small.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausework.operators.lineage import materialise
from clausework.operators.skew import skew_join

DIMENSIONS = ("source", "lang", "topic")
# target share of a category: its token share to this power, normalised; below 1 lifts small categories
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 40
TOLERANCE = 1e-8
# cell tables up to so many rows are raked in one task (tens of bytes each); larger ones are dealt out
ONE_TASK_CELLS = 50_000
# rounds between two writes of the cells
STRIDE = 4
# expected kept tokens as a share of all tokens
RATE = 1.0
SEED = "mix-1"

_WORD = "[^\\x20\\x09-\\x0D]+"


def topic_of(text: Column) -> Column:
    """The tables name no topic; this one goes by what a text is made of."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "listing")
        .when(text.rlike("[Ll]icen[cs]e|[Cc]opyright"), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _cells_of(docs: DataFrame, topic: Column | None) -> DataFrame:
    """``row`` (a whole document), ``source, lang, topic, tokens``; a null category is the empty one."""
    return docs.select(
        F.struct("*").alias("row"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
        F.coalesce(topic_of(F.col("text")) if topic is None else topic, F.lit("")).alias("topic"),
        n_tokens(F.col("text")).alias("tokens"),
    )


def _targets(cells: DataFrame, dim: str, temper: float) -> DataFrame:
    """``dim, target``: tokens per category at the tempered shares; the targets of a dimension sum to all tokens."""
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("own"))
    power = F.when(F.col("own") > 0, F.pow("own", F.lit(temper))).otherwise(0.0)
    total = own.agg(F.sum("own").alias("tokens"), F.sum(power).alias("power")).first()
    scale = total["tokens"] / total["power"] if total["power"] else 0.0
    return own.select(dim, (power * F.lit(scale)).alias("target"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``fitted``: iterative proportional fitting to the targets.

    ``targets`` holds a table ``dim, target`` per dimension; a category without one is fitted to nothing. A round scales
    the cells to each dimension in turn; rounds end when one has moved no cell by more than ``tolerance`` of itself. If
    the last round still moves one, a warning says by how much: targets that contradict each other never settle.
    """
    state = materialise(cells.withColumn("fitted", F.col("tokens").cast("double")), "cells")
    together = state.count() <= ONE_TASK_CELLS
    fixed = {d: materialise(t, "targets") for d, t in targets.items()}
    if together:
        for d, target in fixed.items():
            state = state.join(target.withColumnRenamed("target", f"target_{d}"), d, "left")
        state = materialise(state, "cells")
    for _ in range(0, rounds, STRIDE if together else 1):
        state = _rounds(state, list(fixed), STRIDE) if together else _round(state, fixed)
        state = materialise(state, "cells")
        moved = state.agg(F.max("moved")).first()[0] or 0.0
        if moved <= tolerance:
            break
    else:
        warnings.warn(f"raking has not settled: the last round moved a cell by {moved:.2g} of itself", stacklevel=2)
    return state.select(*cells.columns, "fitted")


def _scaled(state: DataFrame, target: Column) -> DataFrame:
    """Cells with ``sum``, their category's total, scaled to its target; ``moved`` is the largest change in the round."""
    factor = F.when(F.col("sum") > 0, F.coalesce(target, F.lit(0.0)) / F.col("sum")).otherwise(1.0)
    change = F.when(F.col("fitted") > 0, F.abs(factor - 1)).otherwise(0.0)
    return state.withColumns({"moved": F.greatest("moved", change), "fitted": F.col("fitted") * factor}).drop("sum")


def _rounds(state: DataFrame, dims: list[str], rounds: int) -> DataFrame:
    """Several rounds over the cells in one task; the targets stand in the cells."""
    state = state.coalesce(1)
    for _ in range(rounds):
        state = state.withColumn("moved", F.lit(0.0))
        for d in dims:
            state = _scaled(state.withColumn("sum", F.sum("fitted").over(W.partitionBy(d))), F.col(f"target_{d}"))
    return state


def _round(state: DataFrame, fixed: dict[str, DataFrame]) -> DataFrame:
    """One round over many cells: sums with map-side partials, joined back."""
    state = state.withColumn("moved", F.lit(0.0))
    for d, target in fixed.items():
        sums = state.groupBy(d).agg(F.sum("fitted").alias("sum")).join(target, d, "left")
        state = _scaled(state.join(sums, d), F.col("target")).drop("target")
    return state


def chance(seed: str, key: Column) -> Column:
    """A repeatable number in [0, 1) by md5 of the seed and a key; a null key counts as the empty one."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def _weighted(marked: DataFrame, weights: DataFrame) -> DataFrame:
    """Documents with their cell's weight. Few weights are copied to the tasks; with many, a hot cell is split."""
    if weights.count() <= ONE_TASK_CELLS:
        return marked.join(F.broadcast(weights), list(DIMENSIONS))
    return skew_join(marked.withColumn("id", F.col("row.doc_id")), weights, list(DIMENSIONS), salt_by=["id", "tokens"]).drop("id")


def mix(
    docs: DataFrame,
    tempers: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    rate: float = RATE,
    seed: str = SEED,
) -> DataFrame:
    """The sampled documents with ``topic, n_tokens, weight, copies``; columns of those names are replaced.

    ``weight`` is fitted over observed tokens of the document's cell. A document is expected ``rate * weight`` times:
    the whole part of that is sure and the rest its chance of one more, by a hash of its id. So the expected tokens
    of every source, language and topic stand in the target shares. ``copies`` is how often the document counts;
    documents with none go. Null categories form the empty category; documents without words weigh as their cell does.
    Repeated rows share their id's chance; rows without an id share that of an empty one.
    """
    tempers = TEMPERS if tempers is None else tempers
    marked = _cells_of(docs, topic)
    cells = materialise(marked.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {d: _targets(cells, d, tempers[d]) for d in DIMENSIONS}
    weight = F.when(F.col("tokens") > 0, F.round(F.col("fitted") / F.col("tokens"), 6)).otherwise(1.0)
    weights = rake(cells, targets).select(*DIMENSIONS, weight.alias("weight"))
    copies = F.floor(F.col("weight") * rate + chance(seed, F.col("row.doc_id"))).cast("int")
    sampled = _weighted(marked, materialise(weights, "weights")).withColumn("copies", copies).where(F.col("copies") > 0)
    added = {"topic": "topic", "n_tokens": "tokens", "weight": "weight", "copies": "copies"}
    return sampled.select(
        *[F.col(f"row.{c}").alias(c) for c in docs.columns if c not in added],
        *[F.col(own).alias(name) for name, own in added.items()],
    )
