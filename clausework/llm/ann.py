"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, halved again and again at the median along its main spread, so lists are even. They
are searched in memory by beam search over a graph that links every centroid to its nearest ones. A vector is stored in its
nearest list and in every other one that is hardly further (so vectors at a boundary are found from either side); a query
reads the lists whose distance is within a ratio of the nearest, in two rounds: its nearest few lists give it a score that
any further neighbour must reach. Later lists that can't hold one by their radius are skipped, and the others return only
what reaches it. Lists are dealt out by key and cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausework.operators.lineage import materialise

# the centroids are fitted to at most so many vectors and bytes of them, those with the smallest hashes of their ids
SAMPLE_ROWS = 100_000
SAMPLE_BYTES = 128 << 20
# vectors per list that the number of lists aims at, and the most lists (their centroids are copied to the tasks)
LIST_ROWS = 128
MAX_LISTS = 16_384
# links per centroid to its nearest, and centroids of the beam whose links a step of the search follows at once
LINKS = 16
STEP = 2
# a vector is stored in lists up to so much further than its nearest, at most in so many
STORE_RATIO, REPLICAS = 1.10, 4
# a query reads lists up to so much further than its nearest, at most this times the square root of their number
READ_RATIO, READS = 1.3, 3.0
# lists of the first round
FIRST = 8
# stored vectors of one block of a list
BLOCK_ROWS = 4_096


@dataclass
class Centroids:
    vectors: np.ndarray  # unit length
    links: np.ndarray  # per centroid its nearest others, and some far ones so that none is out of reach
    entries: np.ndarray  # where searches begin

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found per unit query, nearest first, and their distances (infinite: none)."""
        n, k = len(queries), len(self.vectors)
        beam = min(beam, k)
        ids = np.zeros((n, beam), np.int64)
        distance = np.full((n, beam), np.inf, np.float32)
        followed = np.zeros((n, beam), bool)
        seen = np.zeros((n, k), bool)
        live = np.arange(n)
        new = np.broadcast_to(self.entries, (n, len(self.entries)))
        while len(live):
            size = new.shape[1]
            fresh = ~seen[live[:, None], new]
            order = np.argsort(new, axis=1, kind="stable")
            again = np.zeros_like(fresh)
            again[np.arange(len(live))[:, None], order[:, 1:]] = np.diff(np.take_along_axis(new, order, axis=1), axis=1) == 0
            fresh &= ~again
            at, column = np.nonzero(fresh)
            who, where = live[at], new[at, column]
            seen[who, where] = True
            added = np.full((len(live), size), np.inf, np.float32)
            added[at, column] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", queries[who], self.vectors[where]), 0))
            near = np.concatenate([distance[live], added], axis=1)
            names = np.concatenate([ids[live], new], axis=1)
            done = np.concatenate([followed[live], np.zeros((len(live), size), bool)], axis=1)
            best = np.argpartition(near, beam - 1, axis=1)[:, :beam]
            near, names, done = (np.take_along_axis(x, best, axis=1) for x in (near, names, done))
            waiting = np.where(done, np.inf, near)
            step = min(STEP, beam)
            picked = np.argpartition(waiting, step - 1, axis=1)[:, :step]
            open_ = np.isfinite(np.take_along_axis(waiting, picked, axis=1))
            rows = np.arange(len(live))[:, None]
            done[rows, picked] |= open_
            distance[live], ids[live], followed[live] = near, names, done
            # where nothing waits, a centroid seen before stands in
            nodes = np.where(open_, names[rows, picked], self.entries[0])
            goes = open_.any(axis=1)
            live = live[goes]
            new = self.links[nodes[goes]].reshape(len(live), step * self.links.shape[1])
        order = np.argsort(distance, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(distance, order, axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def fit_centroids(sample: np.ndarray, lists: int) -> Centroids:
    """Centroids of about ``lists`` even parts of the sample's unit vectors."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists and len(parts[0]) > 1:
        halves = []
        for part in parts:
            rows = sample[part]
            spread = rows - rows.mean(axis=0)
            axis = spread[np.argmax((spread**2).sum(axis=1))]
            for _ in range(8):  # power steps towards the main axis
                axis = spread.T @ (spread @ axis)
                axis /= max(np.linalg.norm(axis), 1e-30)
            order = np.argsort(spread @ axis, kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        parts = [h for h in halves if len(h)]
    vectors = _unit(np.array([sample[p].mean(axis=0) for p in parts]))
    vectors = np.unique(vectors.round(7), axis=0).astype(np.float32)
    k = len(vectors)
    count = min(LINKS, k - 1)
    links = [np.zeros((k, 0), np.int64)]
    if count:
        near = np.empty((k, count), np.int64)
        for lo in range(0, k, 1024):
            product = vectors[lo : lo + 1024] @ vectors.T
            product[np.arange(len(product)), np.arange(lo, lo + len(product))] = -np.inf
            near[lo : lo + 1024] = np.argpartition(-product, count - 1, axis=1)[:, :count]
        links.append(near)
        # halving steps round the ring of all centroids: whatever the nearest links leave apart is joined
        links.append((np.arange(k)[:, None] + k // 2 ** np.arange(1, k.bit_length())) % k)
    entries = np.unique(np.linspace(0, k - 1, min(8, k)).astype(np.int64))
    return Centroids(vectors, np.concatenate([*links, np.arange(k)[:, None]], axis=1), entries)


def _sound(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of vectors that take part."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("vector"), finite.alias("finite"))
    rows = rows.where("vec_id IS NOT NULL AND size(vector) > 0 AND finite").where(F.exists("vector", lambda x: x != 0))
    return rows.select("vec_id", "vector", F.size("vector").alias("width"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _placed(rows: DataFrame, centroids: Centroids, ratio: float, most: int, beam: int) -> DataFrame:
    """``rows`` with ``list, place, angle``: one row per list within the ratio of the nearest, at most ``most``.

    ``place`` counts a row's lists from the nearest, ``angle`` is that to the list's centroid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                order, distance = centroids.search(_unit(_matrix(part.column("vector"))).astype(np.float32), beam)
                order, distance = order[:, :most], distance[:, :most]
                at, column = np.nonzero(np.isfinite(distance) & (distance <= ratio * distance[:, :1] + 1e-6))
                taken = part.take(pa.array(at))
                angle = 2 * np.arcsin(np.minimum(distance[at, column].astype(np.float64) / 2, 1))
                added = [order[at, column].astype(np.int32), column.astype(np.int32), angle]
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, *map(pa.array, added)], names=[*part.schema.names, "list", "place", "angle"]
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, list int, place int, angle double")


def _best_of_blocks(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of every block of the lists a query reads, if they reach its ``floor``."""
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    stored = postings.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    asked = queries.join(sizes, "list").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    both = stored.select("list", "block", F.lit(False).alias("asks"), "vec_id", "vector", F.lit(0.0).alias("floor")).unionByName(
        asked.select("list", "block", F.lit(True).alias("asks"), "vec_id", "vector", "floor")
    )
    dealt = both.repartition("list", "block").sortWithinPartitions("list", "block", "asks", "vec_id")

    def answer(ids, block, query_ids, query_rows, floors) -> pa.RecordBatch:
        norms = np.sqrt((block**2).sum(axis=1))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(query_ids), 256):
            q = np.array(query_rows[lo : lo + 256])
            own = np.array(query_ids[lo : lo + 256])
            score = (q @ block.T) / (np.sqrt((q**2).sum(axis=1))[:, None] * norms[None, :])
            score[own[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                # all that reach the k-th best, so that ties are settled by id later
                bound = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
            else:
                bound = np.full((len(own), 1), -np.inf)
            bound = np.maximum(bound, np.array(floors[lo : lo + 256])[:, None])
            reached = (score >= bound - 1e-9) & np.isfinite(score)
            for i in np.flatnonzero(reached.any(axis=1)):
                at = np.flatnonzero(reached[i])
                # once more pair by pair, so that equal vectors have equal scores wherever they stand
                exact = np.einsum("ij,j->i", block[at], q[i]) / (np.sqrt((q[i] ** 2).sum()) * norms[at])
                best = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(best), own[i]), ids[at][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, block, query_ids, query_rows, floors = None, [], [], None, [], [], []
        for batch in batches:
            lists, blocks, asks, vec_ids = (batch.column(i).to_pylist() for i in range(4))
            matrix = _matrix(batch.column(4)) if batch.num_rows else None
            least = batch.column(5).to_numpy()
            for i, at in enumerate(zip(lists, blocks)):
                if at != key or len(query_ids) >= 4096:
                    if query_ids and ids:
                        block = np.array(rows) if block is None else block
                        yield answer(np.array(ids), block, query_ids, query_rows, floors)
                    query_ids, query_rows, floors = [], [], []
                    if at != key:
                        key, ids, rows, block = at, [], [], None
                if asks[i]:
                    query_ids.append(vec_ids[i])
                    query_rows.append(matrix[i])
                    floors.append(least[i])
                else:
                    ids.append(vec_ids[i])
                    rows.append(matrix[i])
        if query_ids and ids:
            yield answer(np.array(ids), np.array(rows) if block is None else block, query_ids, query_rows, floors)

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, read_ratio: float = READ_RATIO) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query by cosine, ties to the smaller id.

    Both tables have ``vec_id, embedding``; a query isn't its own neighbour. Null and zero vectors and vectors with null,
    non-finite or no components take no part, nor do those of another length than most (of equals, the longest). Rows that
    share an id and a vector are one vector. Of equal vectors only the ``k + 1`` smallest ids are stored, as no other can
    be among a query's ``k`` nearest.
    """
    sound = materialise(_sound(vectors).dropDuplicates(["vec_id", "vector"]), "vectors")
    widths = sound.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, total = widths["width"], widths["count"]
    sound = sound.where(F.col("width") == width).select("vec_id", "vector")
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width))))
    sample = sample.select("vector").toArrow()
    centroids = fit_centroids(_unit(_matrix(sample["vector"].combine_chunks())), min(MAX_LISTS, max(1, total // LIST_ROWS)))
    lists = len(centroids.vectors)
    beam = min(lists, max(2 * FIRST, int(np.ceil(READS * np.sqrt(lists)))))
    # equal vectors: partial counts first, so a vector that fills the table does not meet in one task
    alike = W.partitionBy("h1", "h2").orderBy("vec_id")
    keyed = sound.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    stored = keyed.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).select("vec_id", "vector")
    asked = _sound(queries).dropDuplicates(["vec_id", "vector"]).where(F.col("width") == width).select("vec_id", "vector")
    postings = materialise(_placed(stored, centroids, STORE_RATIO, REPLICAS, max(8, 2 * REPLICAS)), "postings")
    reads = materialise(_placed(asked, centroids, read_ratio, beam, beam), "reads")
    first = reads.where(F.col("place") < FIRST).withColumn("floor", F.lit(float("-inf")))
    near = materialise(_best_of_blocks(postings, first, k), "near")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    floors = best(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    radii = postings.groupBy("list").agg(F.max("angle").alias("radius"))  # at most MAX_LISTS rows
    later = reads.where(F.col("place") >= FIRST).join(floors, "vec_id", "left").join(F.broadcast(radii), "list")
    later = later.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("floor"))))
    later = later.where(F.col("angle") - F.col("radius") <= reach + 1e-4)
    ranked = best(near.unionByName(_best_of_blocks(postings, later, k)))
    return ranked.select("query_id", "rank", "vec_id", "score")
