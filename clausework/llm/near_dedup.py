"""Near-duplicate documents: fast similarity sketches, banding, and exact verification of whole candidate clusters.

A sketch has one coordinate per bin. Rounds of hashing place every shingle in a random bin and keep the smallest hash of
bins not yet filled; after as many rounds as bins, each bin still empty takes the smallest hash of its own round. So all
coordinates are filled, and the share that two sketches agree in concentrates around the Jaccard index.

Texts with equal shingle sets are one class. Classes whose sketches agree in a band fall into one bucket; buckets joined
by common members are candidate clusters. Every similar pair shares a bucket (but for a chance of 5e-8 at similarity 0.8
and 6e-11 at 0.85), so it lies in one cluster. Inside a cluster links are decided on the full sets, in blocks of bounded
size: first within each block, then between the blocks' largest groups, and last between each block and the members
that are outside their cluster's largest group. No list of all pairs is ever made: a member that has joined a group is not
compared with it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausework.llm.common import WordHashes, ascii_words, payloads, shingle_set
from clausework.operators.components import connected_components
from clausework.operators.lineage import materialise

BINS = 128
BAND = 4
# members and shingles of one verification block
BLOCK_ROWS = 512
BLOCK_SHINGLES = 2_000_000
# id lists up to so many rows (8 bytes each) are copied to the tasks; longer ones are joined by shuffle
COPY_ROWS = 1_000_000

_BIN_BITS = np.uint64(57)  # the top 7 bits of a hash are the bin
_LOW = np.uint64((1 << 57) - 1)
_STEP = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUND = _mixed(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` coordinates of 16 bits of a non-empty set of 64-bit hashes."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    step = 1 if len(shingles) >= BINS else _STEP  # rounds looked at together; the values are the same either way
    for i in range(0, BINS, step):
        span = _mixed(shingles[None, :] ^ _ROUND[i : i + step, None])
        turn = np.arange(i, i + step, dtype=np.uint64)[:, None] << np.uint64(50)
        keyed = np.sort(((span & ~_LOW) | turn | ((span & _LOW) >> np.uint64(7))).ravel())  # bin, round, rest of the hash
        bins = (keyed >> _BIN_BITS).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        fresh = first[empty[bins[first]]]
        out[bins[fresh]] = keyed[fresh] & _LOW
        empty[bins[fresh]] = False
        if not empty.any():
            break
    for b in np.flatnonzero(empty):
        out[b] = _mixed(shingles ^ _ROUND[BINS + b]).min()
    return (_mixed(out) & np.uint64(0xFFFF)).astype(np.uint16)


# texts of a batch that are held as bytes at a time
_AT_ONCE = 256


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, s1, s2, sketch``: the set's size, a 128-bit hash of it and its sketch; empty sets have no sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        salt = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            # one set at a time: a batch's sets together take more than its texts
            n, marks, sketches = [], [[], []], []
            for lo in range(0, batch.num_rows, _AT_ONCE):
                for text in payloads(batch.column("text").slice(lo, _AT_ONCE)):
                    s = shingle_set(words.of(ascii_words(text)), size)
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        for mark, seed in zip(marks, (np.uint64(0), salt)):
                            mark.append(int(_mixed(s ^ seed).sum()) if len(s) else 0)
                    sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    *(pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "n", "s1", "s2", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary")


def _candidate_edges(classes: DataFrame) -> DataFrame:
    """``a, b``: members of a bucket, each with the smallest of the bucket."""
    width = 2 * BAND
    bands = F.array(
        *[F.struct(F.lit(j).alias("band"), F.substring("sketch", j * width + 1, width).alias("key")) for j in range(BINS // BAND)]
    )
    rows = classes.select("rep", F.explode(bands).alias("x")).select("rep", F.xxhash64("x.band", "x.key").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    return rows.join(shared.select("bucket", "lead"), "bucket").where("rep > lead").select(
        F.col("rep").alias("a"), F.col("lead").alias("b")
    ).distinct()


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``root, node, shingles`` of the cluster members; the set is packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in (b.slice(lo, _AT_ONCE) for b in batches for lo in range(0, b.num_rows, _AT_ONCE)):
            rows = [shingle_set(words.of(ascii_words(t)), size) for t in payloads(batch.column("text"))]
            keep = pa.array([len(s) > 0 for s in rows])
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("root"),
                    batch.column("node"),
                    pa.array(list(map(len, rows)), pa.int64()),
                    pa.array([s.tobytes() for s in rows], pa.binary()),
                ],
                names=["root", "node", "n", "shingles"],
            )
            yield out.filter(keep)

    ids = F.broadcast(members) if members.count() <= COPY_ROWS else members
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(ids, "node")
    return texts.select("root", "node", "text").mapInArrow(run, "root long, node long, n long, shingles binary")


class _Block:
    """Sets of one block, indexed for overlaps with any other set."""

    def __init__(self, sets: list[bytes]):
        rows = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(r) for r in rows])
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.vocabulary, self.tokens = np.unique(np.concatenate(rows), return_inverse=True)
        self.flags = np.zeros(len(self.vocabulary), bool)

    def similar(self, tokens: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Which sets of the block reach the similarity with a set of ``size`` that has these tokens here."""
        self.flags[tokens] = True
        both = np.add.reduceat(self.flags[self.tokens].astype(np.int64), self.offsets[:-1])
        self.flags[tokens] = False
        return 100 * both >= percent * (self.sizes + size - both)

    def own(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]

    def other(self, packed: bytes) -> tuple[np.ndarray, int]:
        row = np.frombuffer(packed, np.uint64)
        at = np.minimum(np.searchsorted(self.vocabulary, row), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == row], len(row)

    def groups(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Per set the number of its group, and whether the group grew from it. The most typical sets come first."""
        common = np.bincount(self.tokens)[self.tokens]
        typical = np.add.reduceat(common, self.offsets[:-1]) / self.sizes
        group = np.full(len(self.sizes), -1)
        seed = np.zeros(len(self.sizes), bool)
        for i in np.argsort(-typical, kind="stable"):
            if group[i] >= 0:
                continue
            seed[i], group[i] = True, i
            queue = [i]
            while queue:
                k = queue.pop()
                joined = np.flatnonzero(self.similar(self.own(k), self.sizes[k], percent) & (group < 0))
                group[joined] = i
                queue.extend(joined)
                if (group >= 0).all():
                    break
        return group, seed


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with equal first two columns, from rows sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _within_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``root, block, node, comp, hub`` of rows ``root, block, node, shingles``: the groups inside every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            group, seed = _Block([r[3] for r in block]).groups(percent)
            nodes = np.array([r[2] for r in block])
            names = nodes.copy()
            np.minimum.at(names, group, nodes)  # a group's name is its smallest node
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in block]) for i in (0, 1)]
                + [pa.array(nodes), pa.array(names[group]), pa.array(seed)],
                names=["root", "block", "node", "comp", "hub"],
            )

    dealt = rows.select("root", "block", "node", "shingles").repartition("root", "block")
    return dealt.sortWithinPartitions("root", "block", "node").mapInArrow(
        run, "root long, block long, node long, comp long, hub boolean"
    )


def _against_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between rows with ``other`` and block members of another group, one per row, block and group.

    Rows are ``root, block, other, node, comp, shingles``; the members of a block come first and are held, the others
    pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        members: list[tuple] = []
        block = comps = nodes = None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    key, members, block = row[:2], [], None
                if not row[2]:
                    members.append(row)
                    continue
                if not members:
                    continue
                if block is None:
                    block = _Block([m[5] for m in members])
                    nodes, comps = np.array([m[3] for m in members]), np.array([m[4] for m in members])
                near = np.flatnonzero(block.similar(*block.other(row[5]), percent) & (comps != row[4]))
                _, first = np.unique(comps[near], return_index=True)
                links += [(max(row[3], int(n)), min(row[3], int(n))) for n in nodes[near[first]]]
            ends = [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    dealt = rows.select("root", "block", "other", "node", "comp", "shingles").repartition("root", "block")
    return dealt.sortWithinPartitions("root", "block", "other", "node").mapInArrow(run, "a long, b long")


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` with ``a > b``: enough exact links to connect every group of similar sets of each cluster."""
    sizes = sets.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    )
    dealt = sets.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    local = materialise(_within_blocks(dealt, percent), "groups")
    inside = local.where("node > comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return inside
    spread = local.join(large, "root")
    # the largest group of each block, by the row it grew from
    counts = spread.groupBy("root", "block", "comp").agg(F.count("*").alias("rows"))
    first = W.partitionBy("root", "block").orderBy(F.desc("rows"), "comp")
    top = counts.withColumn("place", F.row_number().over(first)).where("place = 1").select("root", "block", "comp")
    hubs = spread.where("hub").join(top, ["root", "block", "comp"]).select("root", "node", "blocks")
    again = hubs.join(sets, ["root", "node"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.ceil(F.col("blocks") / BLOCK_ROWS))
    )
    between = _within_blocks(again, percent).where("node > comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    known = materialise(inside.unionByName(between), "links")
    names = connected_components(known, [])
    placed = spread.select("root", "block", "blocks", "node").join(names.withColumnRenamed("root", "name"), "node", "left")
    placed = materialise(placed.withColumn("comp", F.coalesce("name", "node")).drop("name"), "placed")
    sums = placed.groupBy("root", "comp").agg(F.count("*").alias("rows"))
    most = sums.groupBy("root").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"))
    with_sets = placed.join(sets.select("node", "shingles"), "node")
    outside = (
        with_sets.join(most, "root")
        .where("comp <> main")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    columns = ["root", "block", "node", "comp", "shingles"]
    rows = with_sets.select(*columns, F.lit(False).alias("other")).unionByName(outside.select(*columns, F.lit(True).alias("other")))
    return known.unionByName(_against_blocks(rows, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words lie between ASCII white space, A-Z in lower case; a text's set is its distinct ``size``-word shingles, or all
    its words as one if it has fewer. Texts are linked if ``100 * intersection >= percent * union``; ``component_id`` is
    the smallest id reachable and ``kept`` says that it is the row's own. Texts without words link with nothing. Rows
    that share an id are one node; rows without an id link with nothing, have no component and are kept.
    """
    marked = materialise(_sketches(docs, size), "sketches")
    full = marked.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(
        full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes"
    )
    edges = materialise(_candidate_edges(classes), "edges")
    clusters = connected_components(edges, [])
    members = materialise(
        clusters.unionByName(clusters.select(F.col("root").alias("node"), "root")).distinct(), "members"
    )
    sets = materialise(_sets(docs, members, size), "sets")
    names = connected_components(_linked(sets, percent), [])
    roots = classes.select("s1", "s2", "rep").join(names, F.col("rep") == F.col("node"), "left")
    roots = roots.select("s1", "s2", F.coalesce("root", "rep").alias("component"))
    joined = marked.select("doc_id", "n", "s1", "s2").join(roots, ["s1", "s2"], "left")
    empty = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of every group of near duplicates: the rows of its smallest id."""
    gone = near_duplicates(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"))
    return rows.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")
