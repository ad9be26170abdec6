"""Cosine neighbourhoods by blocked inner products.

Rows of a scope (a split and chunk, say) are cut into blocks of bounded size; a task holds one pair of blocks and multiplies
them. A scope of several memory-sized blocks is cut along a few pivot vectors: rows go to their nearest pivot and stand in the
order of their angle to it, and a block keeps the smallest and largest angle to every pivot. Angles are a metric, so two
blocks whose angles to some pivot lie further apart than eps allows hold no near pair and are never brought together.

What leaves a task depends on the question: pairs within eps for ``eps_neighbours``, otherwise a few numbers per row or a
spanning forest, so dense regions never become lists of pairs. Identical vectors are collapsed to one weighted row beforehand.
"""

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from clausework.operators.lineage import materialise, release
from clausework.operators.positions import row_position
from clausework.operators.skew import skew_join

MAX_BLOCK_ROWS = 65536
MAX_BLOCK_BYTES = 48 << 20
TASK_BYTES = 512 << 20
# pairs of blocks meet in waves once the rows that all of them copy fill more than this: a wave copies a row some WAVE_COPIES times,
# and its copies are gone before the next one, so disk grows with the rows and not with the pairs
WAVE_BYTES = 1 << 30
WAVE_COPIES = 4
MIN_BLOCK_ROWS = 256
TILE_ROWS = 512
RUN_ROWS = 16384  # rows of a block that are joined on their own before the runs meet
STRIP_ROWS = 1024  # rows of a block whose distances to the other block a task holds at once
FIRST_ROWS = 16  # rows of the first strip of a block; strips double up to TILE_ROWS, as what they find spares later ones work
FIRST_COLUMNS = 128
TILE_COLUMNS = 2048
EXACT_ROWS = 1 << 14  # pairs whose distances a task computes anew at once
FEW_ROWS = 20_000  # scopes or blocks that are copied to the tasks, with some 300 bytes each
PIVOT_BLOCKS = 4  # scopes of up to so many memory-sized blocks have too few pairs of them for pivots to pay
PIVOTS = 12
PIVOT_SAMPLE = 256  # rows of a scope that its pivots are chosen from
PIVOT_PAYS = 0.25  # share of sampled pairs that pivots must tell apart; else blocks along them are copied more often for nothing
ANGLE_SLACK = 1e-6  # what rounding may add to an angle


class Collapsed(NamedTuple):
    """Points with identical vectors as one row.

    ``members``: scope, ``id``, ``k1``, ``k2`` of every point, and ``sound``, whether it has a vector to compare. ``reps``: scope, ``rid`` (smallest id of the copies),
    ``weight`` (their number), ``k1``, ``k2``, and ``some``, whether the vector is not zero. ``sizes``: scope, ``n`` vectors of
    length ``d``. ``vectors``: scope, ``rid``, ``weight``, ``vec``, a join with the table ``points``, which nothing else reads.
    """

    members: DataFrame
    reps: DataFrame
    sizes: DataFrame
    scope: list[str]
    vectors: DataFrame
    points: DataFrame


class Blocks(NamedTuple):
    """Vectors cut into blocks. ``rows``: scope, ``rid``, ``weight``, ``vec``, ``block``. ``bounds``: scope, ``block``, its
    ``n`` rows of length ``d`` and the smallest and largest angles ``lo``, ``hi`` to the scope's pivots; null: no pivots.
    ``few``: the bounds may be copied to the tasks. ``n_tasks``: partitions for the pairs of blocks. ``n_bytes``: about what all
    pairs of blocks copy.
    """

    rows: DataFrame
    bounds: DataFrame
    scope: list[str]
    few: bool
    n_tasks: int
    n_bytes: float


def collapse_copies(points: DataFrame, scope: list[str], row_id: str = "id", vec: str = "vec") -> Collapsed:
    """Group points by scope and vector; ids are unique within a scope.

    A vector is keyed by two 64-bit hashes, so the shuffle moves no vectors, and copies meet inside the map tasks. Points
    whose vector is null, empty or holds a null are not compared; vectors of different lengths are an error.
    """
    v = F.col(vec)
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), F.lit(False))
    keyed = points.select(
        *scope,
        F.col(row_id).cast("long").alias("id"),
        v.cast("array<float>").alias("vec"),
        F.xxhash64(v).alias("k1"),
        F.xxhash64(F.lit(1), v).alias("k2"),
        sound.alias("sound"),
    )
    stored = materialise(keyed, "points")
    members = materialise(stored.drop("vec"), "members")
    groups = members.where("sound").groupBy(*scope, "k1", "k2").agg(F.min("id").alias("rid"), F.count("*").alias("weight"))
    groups = materialise(groups, "groups")
    usable = stored.where("sound")
    facts = usable.select(*scope, F.col("id").alias("rid"), F.size("vec").alias("d"), F.exists("vec", lambda x: x != 0).alias("some"))
    reps = materialise(groups.join(facts, [*scope, "rid"]), "reps")
    sizes = reps.groupBy(*scope).agg(F.count("*").alias("n"), F.max("d").alias("d"), F.min("d").alias("least"))
    sizes = materialise(sizes, "sizes")
    odd = sizes.where(F.col("least") < F.col("d")).count()
    if odd:
        raise ValueError(f"vectors of different lengths in {odd} scopes")
    vectors = groups.drop("k1", "k2").join(usable.select(*scope, F.col("id").alias("rid"), "vec"), [*scope, "rid"])
    return Collapsed(members, reps.drop("d"), sizes.where("n > 0").drop("least"), scope, vectors, stored)


def blocks_per_scope(sizes: DataFrame, slots: int, work: float) -> DataFrame:
    """``sizes`` with ``by_memory``, the blocks that a task's memory asks for, and ``n_blocks``.

    Blocks are as large as memory allows, as every row is copied to each block that its own is compared with. They get
    smaller only while all scopes together have too few pairs to occupy the cores twice, each in proportion to its share of
    ``work``, the sum of all squared sizes.
    """
    most = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK_ROWS), F.floor(F.lit(MAX_BLOCK_BYTES) / (4 * F.col("d")))))
    pairs = F.lit(2.0 * slots / work) * F.col("n") * F.col("n")
    for_cores = F.least(F.ceil((F.sqrt(8 * pairs + 1) - 1) / 2), F.floor(F.col("n") / MIN_BLOCK_ROWS))
    by_memory = F.ceil(F.col("n") / most)
    return sizes.withColumn("by_memory", by_memory).withColumn("n_blocks", F.greatest(F.lit(1), "by_memory", for_cores))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which are not zero."""
    n = len(column)
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.empty((0, 1))
    norm = np.sqrt((raw * raw).sum(axis=1))
    nonzero = norm > 0
    return raw / np.where(nonzero, norm, 1.0)[:, None], nonzero


def _reach(eps: float) -> float:
    """The largest angle between vectors within ``eps``."""
    return math.acos(max(-1.0, min(1.0, 1.0 - eps))) + ANGLE_SLACK


def _pivots(sample: DataFrame, scope: list[str], eps: float) -> DataFrame:
    """Scope, ``pivots``: vectors that lie far from each other, one after the other, from a few rows of each scope.

    ``apart`` is the share of pairs of those rows that the angles to the pivots tell to be further apart than ``eps``.
    """
    fields = [*(sample.schema[s] for s in scope), T.StructField("pivots", T.ArrayType(T.FloatType())), T.StructField("apart", T.DoubleType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def choose(table: pa.Table) -> pa.Table:
        unit, nonzero = _units(table["vec"].combine_chunks())
        unit = unit[nonzero] if nonzero.any() else unit
        chosen = [0]
        nearest = unit @ unit[0]
        while len(chosen) < PIVOTS:  # a scope of fewer different rows repeats some
            chosen.append(int(np.argmin(nearest)))
            nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        flat = pa.array(unit[chosen].astype(np.float32).ravel())
        value = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        angles = np.arccos(np.clip(unit @ unit[chosen].T, -1, 1))
        apart = (np.abs(angles[:, None] - angles[None]) > _reach(eps)).any(axis=2).mean()
        return pa.table([*(table[s].slice(0, 1) for s in scope), value, pa.array([float(apart)])], schema=arrow)

    return sample.groupBy(*scope).applyInArrow(choose, schema)


def _angles(rows: DataFrame, pivots: DataFrame, scope: list[str]) -> DataFrame:
    """``rows`` (scope, ``part``, ``rid``, ``weight``, ``vec``) with ``cell``, the nearest pivot, and ``angles`` to all.

    A zero vector has no angles and a cell of its own. A part is a bounded number of rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angles", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        unit, nonzero = _units(left["vec"].combine_chunks())
        pivot = right["pivots"].combine_chunks()
        if not len(unit) or not len(pivot):
            return arrow.empty_table()
        pivot, _ = _units(pa.ListArray.from_arrays(pa.array(np.arange(PIVOTS + 1) * unit.shape[1], pa.int32()), pivot.flatten()))
        angles = np.arccos(np.clip(unit @ pivot.T, -1, 1))
        cell = np.where(nonzero, angles.argmin(axis=1), PIVOTS).astype(np.int32)
        flat = pa.array(angles[nonzero].ravel())
        ends = np.r_[0, np.cumsum(np.where(nonzero, PIVOTS, 0))].astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~nonzero))
        return pa.table([*(left[c] for c in left.schema.names), pa.array(cell), values], schema=arrow)

    keys = [*scope, "part"]
    other = pivots.select(*[F.col(s).alias(s) for s in scope], F.col("part").alias("part"), F.col("pivots").alias("pivots"))
    return rows.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(measure, schema)


def place_blocks(c: Collapsed, eps: float | None = None) -> Blocks:
    """Cut the vectors of every scope into blocks of bounded size.

    Scopes of a few memory-sized blocks are cut by a hash, if only to occupy the cores; larger ones by pivots, where a
    cell's rows are cut into even runs by their exact places in the order of angles. Where the pivots would tell few pairs
    of a sample to be further apart than ``eps``, if given, a hash cuts those as well.
    """
    slots = c.reps.sparkSession.sparkContext.defaultParallelism
    scope = c.scope
    work = c.sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 1.0
    sizes = blocks_per_scope(c.sizes, slots, work)
    pairs = F.col("n_blocks").cast("double") * (F.col("n_blocks") + 1) / 2
    volume = F.col("n").cast("double") * F.col("n_blocks") * F.col("d") * 4
    facts = sizes.agg(F.count("*"), F.max("by_memory"), F.sum("n_blocks"), F.sum(pairs), F.sum(volume)).first()
    n_scopes, cuts, n_blocks, n_pairs, n_bytes = (x or 0 for x in facts)
    n_tasks = int(max(1, min(n_pairs, max(4 * slots, math.ceil(n_bytes / TASK_BYTES)))))
    narrow = c.vectors.select(*scope, "rid", "weight", "vec")
    on = [*scope, "_one"]  # a scope may have no columns
    one = F.when(F.col("rid").isNotNull(), 1).alias("_one")
    by_scope = sizes.withColumn("_one", F.when(F.col("n") > 0, 1))

    def with_sizes(rows: DataFrame) -> DataFrame:
        if n_scopes <= FEW_ROWS:
            return rows.select("*", one).join(F.broadcast(by_scope), on).drop("_one")
        return skew_join(rows.select("*", one), by_scope, on, salt_by=["rid"]).drop("_one")

    sized = with_sizes(narrow)
    no_angles = F.lit(None).cast("array<double>")
    block = F.pmod(F.xxhash64("rid"), F.col("n_blocks")).cast("long")  # even but for chance
    hashed = sized.where(F.col("by_memory") <= PIVOT_BLOCKS).select(*scope, "rid", "weight", "vec", block.alias("block"), no_angles.alias("angles"))
    pays = False
    if cuts > PIVOT_BLOCKS:
        large = sized.where(F.col("by_memory") > PIVOT_BLOCKS)
        few = W.partitionBy(*scope).orderBy(F.xxhash64("rid"), "rid")
        named = with_sizes(c.reps.select(*scope, "rid").distinct()).where(F.col("by_memory") > PIVOT_BLOCKS)
        named = named.select(*scope, "rid", F.row_number().over(few).alias("_at")).where(F.col("_at") <= PIVOT_SAMPLE)
        sample = c.vectors.join(named.drop("_at"), [*scope, "rid"])
        pivots = materialise(_pivots(sample.select(*scope, "vec"), scope, -1.0 if eps is None else eps), "pivots")
        pays = eps is None or pivots.agg(F.avg("apart")).first()[0] >= PIVOT_PAYS
    if cuts <= PIVOT_BLOCKS:
        rows = materialise(hashed, "blocks")
    elif not pays:
        rows = materialise(sized.select(*scope, "rid", "weight", "vec", block.alias("block"), no_angles.alias("angles")), "blocks")
    else:
        large = materialise(large, "large")
        parts = F.ceil(F.col("n") / MAX_BLOCK_ROWS).cast("long")
        every = sizes.where(F.col("by_memory") > PIVOT_BLOCKS).select(*scope, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.when(F.col("n") > 0, 1).alias("_one"))
        pivots = pivots.drop("apart").withColumn("_one", F.when(F.size("pivots") > 0, 1))
        dealt = every.join(pivots, on).drop("_one")
        part = F.pmod(F.xxhash64(F.lit(1), "rid"), parts)
        measured = materialise(_angles(large.select(*scope, part.alias("part"), "rid", "weight", "vec"), dealt, scope).drop("part"), "angles")
        own = F.coalesce(F.col("angles")[F.col("cell")], F.lit(0.0))
        placed = row_position(measured.select(*scope, "cell", own.alias("angle"), "rid"), [*scope, "cell", "angle", "rid"], "_at")
        cells = placed.groupBy(*scope, "cell").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        cells = cells.withColumn("_one", F.when(F.col("_n") > 0, 1)).join(sizes.withColumn("_one", F.when(F.col("n") > 0, 1)), on)
        cells = cells.withColumn("_k", F.ceil(F.col("_n") * F.col("n_blocks") / F.col("n")))
        # at most one cell per pivot and one for zero vectors
        before = W.partitionBy(*scope).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumn("_from", F.coalesce(F.sum("_k").over(before), F.lit(0))).select(*scope, "cell", "_first", "_n", "_k", "_from")
        numbered = skew_join(materialise(placed.drop("angle"), "places"), cells, [*scope, "cell"], salt_by=["rid"])
        run = F.floor((F.col("_at") - F.col("_first")) * F.col("_k") / F.col("_n"))
        numbered = numbered.select(*scope, "rid", (F.col("_from") + run).cast("long").alias("block"))
        cut = measured.join(numbered, [*scope, "rid"]).select(*scope, "rid", "weight", "vec", "block", "angles")
        rows = materialise(hashed.unionByName(cut), "blocks")
        release(large, measured)
    ends = [F.array(*[f(F.col("angles")[i]) for i in range(PIVOTS)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    bounds = rows.groupBy(*scope, "block").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.count("angles").alias("_with"), *ends)
    known = F.col("_with") == F.col("n")
    bounds = bounds.select(*scope, "block", "n", "d", *[F.when(known, F.col(x)).alias(x) for x in ("lo", "hi")], F.when(F.col("n") > 0, 1).alias("_one"))
    # cells' last blocks are not full: at most one more block per cell
    few = n_blocks + (PIVOTS + 1) * n_scopes * pays <= FEW_ROWS
    return Blocks(rows, materialise(bounds, "bounds"), scope, few, n_tasks, float(n_bytes))


def block_pairs(b: Blocks, eps: float) -> DataFrame:
    """Scope, ``bi <= bj``: the pairs of blocks that may hold vectors within ``eps``."""
    angle = _reach(eps)
    sides = [b.bounds.select(*b.scope, "_one", *[F.col(x).alias(f"{x}_{side}") for x in ("block", "lo", "hi")]) for side in "ij"]
    on = [*b.scope, "_one"]
    if b.few:
        both = sides[0].join(F.broadcast(sides[1]), on)
    else:
        both = skew_join(sides[0], sides[1], on, salt_by=["block_i"], rows_per_task=512)
    apart = F.exists(
        F.sequence(F.lit(0), F.lit(PIVOTS - 1)),
        lambda p: F.greatest(F.col("lo_i")[p] - F.col("hi_j")[p], F.col("lo_j")[p] - F.col("hi_i")[p]) > angle,
    )
    met = both.where((F.col("block_i") <= F.col("block_j")) & ~F.coalesce(apart, F.lit(False)))
    return met.select(*b.scope, F.col("block_i").alias("bi"), F.col("block_j").alias("bj"))


def _over_pairs(rows: DataFrame, b: Blocks, eps: float, run: Callable, schema: T.StructType, own: bool = True) -> DataFrame:
    """What ``run`` gives of every pair of blocks, or without ``own`` of every pair of two; each row is copied to the pairs of its block.

    The number of partitions is set here: the work is compute, and small inputs must not be coalesced into one task.
    """
    pairs = block_pairs(b, eps) if own else block_pairs(b, eps).where("bi < bj")
    if not b.few:
        pairs = materialise(pairs, "block-pairs")
    keys = [*b.scope, "bi", "bj"]

    def ends(some: DataFrame) -> DataFrame:
        left = some.select(*b.scope, F.col("bi").alias("block"), "bi", "bj", F.lit(True).alias("is_left"))
        right = some.where("bi < bj").select(*b.scope, F.col("bj").alias("block"), "bi", "bj", F.lit(False).alias("is_left"))
        return left.unionByName(right)

    def met(some: DataFrame, n_tasks: int) -> DataFrame:
        paired = rows.drop("angles").join(ends(some), [*b.scope, "block"]).drop("block")
        return paired.repartition(n_tasks, *keys).groupBy(*keys).applyInArrow(run, schema)

    waves = 1
    if b.n_bytes > WAVE_BYTES:
        on = [*b.scope, "block"]
        copies = ends(pairs).join(b.bounds.select(*on, "n", "d"), on)
        copied, n_bytes = copies.agg(F.sum("n"), F.sum(F.col("n") * F.col("d") * 4)).first()
        n_rows = b.bounds.agg(F.sum("n")).first()[0]
        waves = max(1, min(math.ceil((copied or 0) / n_rows / WAVE_COPIES), math.ceil((n_bytes or 0) / WAVE_BYTES)))
    if waves == 1:
        return met(pairs, b.n_tasks)
    # a block meets as many others in every wave
    found = [materialise(met(pairs.where(F.pmod(F.col("bi") + F.col("bj"), F.lit(waves)) == w), math.ceil(b.n_tasks / waves)), "wave") for w in range(waves)]
    return reduce(DataFrame.unionByName, found)


class _Side(NamedTuple):
    rid: np.ndarray
    weight: np.ndarray
    unit: np.ndarray
    nonzero: np.ndarray
    extra: np.ndarray | None
    parts: np.ndarray | None = None  # per row and radius, the smallest id that it is connected to inside its block

    def of_rows(self, rows) -> "_Side":
        return _Side(*(None if x is None else x[rows] for x in self))


def _side(table: pa.Table, extra: str | None) -> _Side:
    n = table.num_rows
    unit, nonzero = _units(table["vec"].combine_chunks())
    payload = parts = None
    if extra:
        payload = table[extra].combine_chunks() if n else None
        payload = np.empty(0) if payload is None else payload.to_numpy(zero_copy_only=False)
    if "parts" in table.column_names and n:
        parts = table["parts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return _Side(table["rid"].to_numpy(), table["weight"].to_numpy().astype(np.float64), unit, nonzero, payload, parts)


def _read_sides(batches, extra: str | None) -> tuple[_Side, _Side]:
    table = pa.Table.from_batches(list(batches))
    left = table["is_left"].combine_chunks()
    return tuple(_side(table.filter(mask).combine_chunks(), extra) for mask in (left, pa.compute.invert(left)))


def _tiles(a: _Side, b: _Side, same: bool):
    """Distances between slices of ``a`` and of ``b``, small enough for the cache; a vector is at distance 0 from itself."""
    for start in range(0, len(a.rid), TILE_ROWS):
        rows = slice(start, min(start + TILE_ROWS, len(a.rid)))
        for first in range(0, len(b.rid), TILE_ROWS):
            cols = slice(first, min(first + TILE_ROWS, len(b.rid)))
            dist = a.unit[rows] @ b.unit[cols].T
            np.subtract(1.0, dist, out=dist)
            if same and first == start:
                np.fill_diagonal(dist, np.where(a.nonzero[rows], 0.0, 1.0))
            yield rows, cols, dist


def _fast_tiles(a: _Side, b: _Side, same: bool):
    """Inner products in single precision of strips of ``a`` and slices of ``b``, a strip at a time.

    They are off by less than ``_slack``; ``_exact`` settles what is closer to a bound than that.
    """
    left = a.unit.astype(np.float32)
    right = left if same else b.unit.astype(np.float32)
    cuts = [0, *range(FIRST_COLUMNS, len(b.rid), TILE_COLUMNS), len(b.rid)]
    start, step = 0, FIRST_ROWS
    while start < len(a.rid):
        rows = slice(start, min(start + step, len(a.rid)))
        for first, last in zip(cuts, cuts[1:]):
            if first < last:
                yield rows, slice(first, last), left[rows] @ right[first:last].T
        start, step = rows.stop, min(2 * step, TILE_ROWS)


def _slack(a: _Side) -> float:
    """More than single precision takes from an inner product of two unit vectors."""
    return (a.unit.shape[1] + 8) * 2.0**-23


def _hits(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the set flags, few among many: eight are looked at at a time."""
    flat = flags.ravel()
    whole = len(flat) & -8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, flags.shape[1])


def _exact(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, same: bool) -> np.ndarray:
    """Distances of the pairs ``i, j`` in double precision; a vector is at distance 0 from itself."""
    dist = np.empty(len(i))
    for at in range(0, len(i), EXACT_ROWS):
        cut = slice(at, at + EXACT_ROWS)
        dist[cut] = 1.0 - np.einsum("ij,ij->i", a.unit[i[cut]], b.unit[j[cut]])
    if same:
        own = i == j
        dist[own] = np.where(a.nonzero[i[own]], 0.0, 1.0)
    return dist


def _batch(schema: pa.Schema, scope_values: list, columns: list[np.ndarray]) -> pa.RecordBatch:
    n = len(columns[0])
    fixed = [pa.array([value] * n, type=field.type) for value, field in zip(scope_values, schema)]
    rest = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[len(scope_values) :])]
    return pa.RecordBatch.from_arrays([*fixed, *rest], schema=schema)


def _schemas(c: Collapsed, fields: list[tuple[str, T.DataType]]) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType([*(c.reps.schema[s] for s in c.scope), *(T.StructField(n, t) for n, t in fields)])
    return schema, to_arrow_schema(schema)


def eps_pairs(c: Collapsed, blocks: Blocks, eps: float) -> DataFrame:
    """Pairs of distinct vectors at cosine distance ``<= eps``, tile by tile; see ``eps_neighbours``."""
    fields = [("id_a", T.LongType()), ("id_b", T.LongType()), ("dist", T.DoubleType())]
    schema, arrow = _schemas(c, [*fields, ("copies_a", T.LongType()), ("copies_b", T.LongType())])
    n_scope = len(c.scope)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = [k.as_py() for k in key[:n_scope]]
        same = key[-1].as_py() == key[-2].as_py()
        a, b = _read_sides(batches, None)
        if same:
            b = a
        least = np.float32(1.0 - eps - _slack(a))
        for rows, cols, product in _fast_tiles(a, b, same):
            near = product >= least
            if same:
                near &= a.rid[rows][:, None] < b.rid[cols][None, :]
            i, j = _hits(near)
            i, j = i + rows.start, j + cols.start
            dist = _exact(a, b, i, j, same)
            hit = dist <= eps
            if hit.any():
                i, j = i[hit], j[hit]
                left, right = a.rid[i], b.rid[j]
                n_left, n_right = a.weight[i].astype(np.int64), b.weight[j].astype(np.int64)
                swap = left > right
                yield _batch(
                    arrow,
                    scope,
                    [
                        np.where(swap, right, left),
                        np.where(swap, left, right),
                        dist[hit],
                        np.where(swap, n_right, n_left),
                        np.where(swap, n_left, n_right),
                    ],
                )

    return _over_pairs(blocks.rows, blocks, eps, run, schema)


def eps_neighbours(points: DataFrame, eps: float, scope: list[str] = (), row_id: str = "id", vec: str = "vec") -> DataFrame:
    """``id_a, id_b, dist, copies_a, copies_b``: all pairs within ``eps``, without loss, copies of a vector as one row.

    A vector that occurs ``n`` times is named by its smallest id, with ``copies = n``. A row of two vectors stands for
    ``copies_a * copies_b`` point pairs; a row with ``id_a = id_b``, at distance 0, for the ``n * (n - 1) / 2`` pairs among
    the copies of one vector. ``copy_members`` gives the points behind an id, so every pair can be rebuilt.
    """
    return near_pairs(collapse_copies(points, list(scope), row_id, vec), eps)


def near_pairs(c: Collapsed, eps: float) -> DataFrame:
    """The rows of ``eps_neighbours`` for points that are collapsed already."""
    alike = c.reps.where("weight > 1 AND some")
    copies = alike.select(
        *c.scope,
        F.col("rid").alias("id_a"),
        F.col("rid").alias("id_b"),
        F.lit(0.0).alias("dist"),
        F.col("weight").alias("copies_a"),
        F.col("weight").alias("copies_b"),
    )
    return eps_pairs(c, place_blocks(c, eps), eps).unionByName(copies)


def point_pairs(c: Collapsed, eps: float) -> DataFrame:
    """Scope, ``id_a, id_b, dist``: every pair of points within ``eps``, copies by their own ids, the smaller id first.

    Points of one id and one vector are a pair ``id, id``.
    """
    pairs = near_pairs(c, eps).select(*c.scope, "id_a", "id_b", "dist")
    keys = [*c.scope, "k1", "k2"]
    points = c.members.where("sound").groupBy(*keys, "id").agg((F.count("*") > 1).alias("twice"))
    named = skew_join(points, c.reps.select(*keys, "rid").distinct(), keys, salt_by=["id"])
    named = materialise(named.groupBy(*c.scope, "id", "rid").agg(F.max("twice").alias("twice")), "copies")
    if named.where("NOT id <=> rid").isEmpty():
        return pairs
    pairs = materialise(pairs, "pairs")
    for side in "ab":
        points = named.select(*c.scope, F.col("rid").alias(f"id_{side}"), F.col("id").alias(f"point_{side}"), F.col("twice").alias(f"twice_{side}"))
        pairs = skew_join(pairs, points, [*c.scope, f"id_{side}"], salt_by=["id_a", "id_b"])
    kept = pairs.where("id_a <> id_b OR point_a < point_b OR (point_a = point_b AND twice_a)").where("point_a IS NOT NULL AND point_b IS NOT NULL")
    return kept.select(*c.scope, F.least("point_a", "point_b").alias("id_a"), F.greatest("point_a", "point_b").alias("id_b"), "dist")


def copy_members(points: DataFrame, scope: list[str] = (), row_id: str = "id", vec: str = "vec") -> DataFrame:
    """Scope, ``id``, ``rid``: the smallest id with the same vector, for every point that has one."""
    return members_of(collapse_copies(points, list(scope), row_id, vec))


def members_of(c: Collapsed) -> DataFrame:
    """The rows of ``copy_members`` for points that are collapsed already."""
    keys = [*c.scope, "k1", "k2"]
    return skew_join(c.members.where("sound"), c.reps.select(*keys, "rid"), keys, salt_by=["id"]).select(*c.scope, "id", "rid")


def near_counts(c: Collapsed, blocks: Blocks, eps: float) -> DataFrame:
    """Scope, ``rid``, ``n``, ``nearest``: the other points within ``eps`` of each vector's points, and the nearest one's distance.

    A vector without any has no row. Every pair of blocks sends one row per vector, not its pairs.
    """
    schema, arrow = _schemas(c, [("rid", T.LongType()), ("n", T.LongType()), ("nearest", T.DoubleType())])
    n_scope = len(c.scope)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = [k.as_py() for k in key[:n_scope]]
        same = key[-1].as_py() == key[-2].as_py()
        a, b = _read_sides(batches, None)
        of_a = (a.rid, np.zeros(len(a.rid), np.int64), np.full(len(a.rid), np.inf))
        if same:
            b, of_b = a, of_a
        else:
            of_b = (b.rid, np.zeros(len(b.rid), np.int64), np.full(len(b.rid), np.inf))
        least = np.float32(1.0 - eps - _slack(a))
        for rows, cols, product in _fast_tiles(a, b, same):
            near = product >= least
            if same:
                near &= a.rid[rows][:, None] < b.rid[cols][None, :]
            i, j = _hits(near)
            i, j = i + rows.start, j + cols.start
            dist = _exact(a, b, i, j, same)
            hit = dist <= eps
            i, j, dist = i[hit], j[hit], dist[hit]
            for (_, n, nearest), at, weight in ((of_a, i, b.weight[j]), (of_b, j, a.weight[i])):
                np.add.at(n, at, weight.astype(np.int64))
                np.minimum.at(nearest, at, dist)
        for rid, n, nearest in (of_a,) if same else (of_a, of_b):
            some = n > 0
            if some.any():
                yield _batch(arrow, scope, [rid[some], n[some], nearest[some]])

    partial = _over_pairs(blocks.rows, blocks, eps, run, schema)
    copies = c.reps.where("weight > 1 AND some").select(*c.scope, "rid", (F.col("weight") - 1).alias("n"), F.lit(0.0).alias("nearest"))
    return partial.unionByName(copies).groupBy(*c.scope, "rid").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


def neighbour_counts(c: Collapsed, blocks: Blocks, eps_list: list[float]) -> DataFrame:
    """Scope, ``rid``, ``e`` (index into ``eps_list``), ``n``: points within eps of each vector, itself and copies included.

    One distance computation serves all eps; each task sends one number per row, eps and block.
    """
    schema, arrow = _schemas(c, [("rid", T.LongType()), ("e", T.IntegerType()), ("n", T.LongType())])
    n_scope = len(c.scope)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = [k.as_py() for k in key[:n_scope]]
        same = key[-1].as_py() == key[-2].as_py()
        a, b = _read_sides(batches, None)
        if same:
            b = a
        of_a = np.zeros((len(eps_list), len(a.rid)))
        of_b = np.zeros((len(eps_list), len(b.rid)))
        for rows, cols, dist in _tiles(a, b, same):
            for e, eps in enumerate(eps_list):
                near = (dist <= eps).astype(np.float64)
                of_a[e, rows] += near @ b.weight[cols]
                if not same:
                    of_b[e, cols] += a.weight[rows] @ near
        for side, counts in ((a, of_a),) if same else ((a, of_a), (b, of_b)):
            for e in range(len(eps_list)):
                hit = counts[e] > 0
                if hit.any():
                    yield _batch(
                        arrow, scope, [side.rid[hit], np.full(hit.sum(), e), np.rint(counts[e][hit]).astype(np.int64)]
                    )

    partial = _over_pairs(blocks.rows, blocks, max(eps_list), run, schema)
    return partial.groupBy(*c.scope, "rid", "e").agg(F.sum("n").alias("n"))


def core_flags(points: DataFrame, eps: float, min_samples: int = 5, scope: list[str] = (), row_id: str = "id", vec: str = "vec") -> DataFrame:
    """``id, n_neighbours, is_core`` of each point: neighbours include the point itself."""
    c = collapse_copies(points, list(scope), row_id, vec)
    counts = neighbour_counts(c, place_blocks(c, eps), [eps]).drop("e")
    reps = c.reps.select(*c.scope, "k1", "k2", "rid").join(counts, [*c.scope, "rid"], "left")
    per_point = skew_join(c.members, reps, [*c.scope, "k1", "k2"], "left", salt_by=["id"])
    n = F.coalesce("n", F.lit(0))
    return per_point.select(*c.scope, "id", n.alias("n_neighbours"), (n >= min_samples).alias("is_core"))


def _first_of_rows(found: list[tuple], k: int) -> list[np.ndarray]:
    """Of entries (row, distance, id, weight), the first ``k`` of each row."""
    row, dist, rid, weight = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((rid, dist, row))
    row = row[order]
    new = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else np.empty(0, np.int64)
    keep = np.arange(len(row)) - start < k
    return [row[keep], *(c[order][keep] for c in (dist, rid, weight))]


_NEAR = T.ArrayType(
    T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("rid", T.LongType()), T.StructField("weight", T.LongType())])
)


def near_lists(c: Collapsed, blocks: Blocks, eps: float, k: int) -> DataFrame:
    """Scope, ``rid``, ``near``: the ``k`` nearest vectors within ``eps`` of each, itself included, nearest first.

    ``near`` holds distance, id and weight. A vector with fewer than ``k`` points around it has them all in its list.
    """
    schema, arrow = _schemas(c, [("rid", T.LongType()), ("near", _NEAR)])
    n_scope = len(c.scope)

    def lists(scope: list, side: _Side, entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, dist, rid, weight = entries
        if not len(row):
            return
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        fields = list(arrow.field("near").type.value_type)
        values = pa.StructArray.from_arrays(
            [pa.array(x, f.type) for x, f in zip((dist, rid, weight.astype(np.int64)), fields)], fields=fields
        )
        near = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), values)
        yield _batch(arrow, scope, [side.rid[row[starts]], near.cast(arrow.field("near").type)])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = [x.as_py() for x in key[:n_scope]]
        same = key[-1].as_py() == key[-2].as_py()
        a, b = _read_sides(batches, None)
        if same:
            b = a
        nothing = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.float64))
        slack = _slack(a)
        # the least inner product that a row still asks for: as soon as it has k entries, that of its last one
        least_a, least_b = (np.full(len(x.rid), 1.0 - eps - slack, np.float32) for x in (a, b))

        def first(found: list[tuple], least: np.ndarray) -> list[np.ndarray]:
            entries = _first_of_rows(found, k)
            row, dist = entries[:2]
            if len(row) >= k:
                full = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) + k - 1
                least[row[full]] = 1.0 - dist[full] - slack
            return entries

        of_a, of_b, strip = [nothing], [nothing], 0
        for rows, cols, product in _fast_tiles(a, b, same):
            if rows.start != strip:
                yield from lists(scope, a, first(of_a, least_a))
                of_a, of_b, strip = [nothing], [tuple(first(of_b, least_b))], rows.start
            near = product >= least_a[rows][:, None]
            if not same:
                near |= product >= least_b[cols][None, :]
            i, j = _hits(near)
            i, j = i + rows.start, j + cols.start
            dist = _exact(a, b, i, j, same)
            hit = dist <= eps
            i, j, dist = i[hit], j[hit], dist[hit]
            if len(i):
                of_a = [tuple(first([*of_a, (i, dist, b.rid[j], b.weight[j])], least_a))]
                if not same:
                    of_b.append((j, dist, a.rid[i], a.weight[i]))
        yield from lists(scope, a, first(of_a, least_a))
        yield from lists(scope, b, first(of_b, least_b))

    partial = _over_pairs(blocks.rows, blocks, eps, run, schema)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return partial.groupBy(*c.scope, "rid").agg(merged.alias("near"))


def _kruskal(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a lightest forest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), weight))
    parent = list(range(len(names)))
    kept = []
    for at, u, v in zip(order.tolist(), ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist()):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[u] = v
            kept.append(at)
    return np.array(kept, np.int64)


def _prim(weight: np.ndarray, left: slice, right: slice, size: int) -> tuple[list, list, list]:
    """A lightest forest of the graph whose edge between ``left`` and ``right`` vertices is in ``weight`` (infinite: none).

    The two may overlap, when a strip of a block is set against the whole block.
    """
    best, parent, todo = np.full(size, np.inf), np.zeros(size, np.int64), np.zeros(size, bool)
    some = np.isfinite(weight)
    todo[left] |= some.any(axis=1)
    todo[right] |= some.any(axis=0)
    starts = iter(np.flatnonzero(todo).tolist())
    a, b, w = [], [], []
    while True:
        v = int(np.argmin(best))
        if best[v] == np.inf:
            v = next((x for x in starts if todo[x]), -1)
            if v < 0:
                return a, b, w
        else:
            a.append(v)
            b.append(int(parent[v]))
            w.append(float(best[v]))
        todo[v], best[v] = False, np.inf
        if left.start <= v < left.stop:
            line, others = weight[v - left.start], right
        else:
            line, others = weight[:, v - right.start], left
        closer = (line < best[others]) & todo[others]
        best[others][closer] = line[closer]
        parent[others][closer] = v


def reach_forest(c: Collapsed, blocks: Blocks, cores: DataFrame, eps: float) -> DataFrame:
    """Scope, ``a > b``, ``weight``: edges between core vectors whose cut at any radius up to ``eps`` connects them exactly.

    ``cores`` has scope, ``rid`` and ``core``, the distance within which a vector has enough points. An edge weighs the
    largest of its length and its ends' core distances, so at radius ``r`` the edges up to ``r`` are the links of cores.
    Every block pair sends a lightest forest of its own edges, fewer than it has rows. An edge that is not in one is the
    heaviest of a circle, which no lightest forest of all edges needs.
    """
    schema, arrow = _schemas(c, [("a", T.LongType()), ("b", T.LongType()), ("weight", T.DoubleType())])
    n_scope = len(c.scope)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = [k.as_py() for k in key[:n_scope]]
        same = key[-1].as_py() == key[-2].as_py()
        a, b = _read_sides(batches, "core")
        if same:
            b = a
        if not len(a.rid) or not len(b.rid):  # a block without cores
            return
        names = a.rid if same else np.concatenate([a.rid, b.rid])
        right = slice(0, len(a.rid)) if same else slice(len(a.rid), len(names))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for start in range(0, len(a.rid), STRIP_ROWS):
            left = slice(start, min(start + STRIP_ROWS, len(a.rid)))
            weight = 1.0 - a.unit[left] @ b.unit.T
            np.maximum(weight, a.extra[left][:, None], out=weight)
            np.maximum(weight, b.extra[None, :], out=weight)
            weight[weight > eps] = np.inf
            if same:
                weight[np.arange(left.stop - left.start), np.arange(left.start, left.stop)] = np.inf
            some = np.isfinite(weight)
            if some.sum() <= 8 * sum(weight.shape):
                i, j = np.nonzero(some)
                u, v, w = names[left.start + i], names[right.start + j], weight[i, j]
                kept = _kruskal(u, v, w)
                found.append((u[kept], v[kept], w[kept]))
            else:
                u, v, w = _prim(weight, left, right, len(names))
                found.append((names[u], names[v], np.array(w)))
        u, v, w = (np.concatenate(x) for x in zip(*found))
        kept = _kruskal(u, v, w)
        if len(kept):
            u, v = u[kept], v[kept]
            yield _batch(arrow, scope, [np.maximum(u, v), np.minimum(u, v), w[kept]])

    rows = blocks.rows.join(cores, [*c.scope, "rid"])
    return _over_pairs(rows, blocks, eps, run, schema)


class _Parts:
    """Vertices of two blocks and the part that each belongs to so far; parts are named by one of their vertices."""

    def __init__(self, size: int):
        self.of = np.arange(size, dtype=np.int32)

    def join(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places of the edges ``u, v`` that bring parts together; the others are redundant."""
        left, right = self.of[u], self.of[v]
        low, high = np.minimum(left, right).astype(np.int64), np.maximum(left, right)
        _, at = np.unique(low * len(self.of) + high, return_index=True)
        up: dict[int, int] = {}
        kept = []
        for place, x, y in zip(at.tolist(), left[at].tolist(), right[at].tolist()):
            while (above := up.get(x, x)) != x:
                up[x] = x = up.get(above, above)
            while (above := up.get(y, y)) != y:
                up[y] = y = up.get(above, above)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(place)
        if kept:
            names = np.arange(len(self.of), dtype=np.int32)
            for x in sorted(up):  # a part is joined to one with a smaller name
                names[x] = names[up[x]]
            self.of = names[self.of]
        return np.array(kept, np.int64)


def _join_tile(parts: list[_Parts], tile: tuple, a: _Side, b: _Side, same: bool, first: int, shift: int, eps_list: list[float]) -> list[tuple]:
    """Join what a tile of inner products connects; the edges ``e, u, v`` that did so.

    Row ``i`` of ``a`` is vertex ``first + i``, row ``j`` of ``b`` is ``shift + j``.
    """
    rows, cols, product = tile
    slack = _slack(a)
    found = []
    for e, eps in enumerate(eps_list):
        of = parts[e].of
        open_ = product >= np.float32(1.0 - eps - slack)
        open_ &= of[first + rows.start : first + rows.stop][:, None] != of[shift + cols.start : shift + cols.stop][None, :]
        i, j = _hits(open_)
        if not len(i):
            continue
        sure = product[i, j] >= np.float32(1.0 - eps + slack)
        i, j = i + rows.start, j + cols.start
        doubtful = np.flatnonzero(~sure)
        sure[doubtful] = _exact(a, b, i[doubtful], j[doubtful], same) <= eps
        if a.extra is not None:
            sure &= (a.extra[i] <= eps) & (b.extra[j] <= eps)
        i, j = first + i[sure], shift + j[sure]
        kept = parts[e].join(i, j)
        if len(kept):
            found.append((e, i[kept], j[kept]))
    return found


def _largest_first(of: np.ndarray) -> tuple[np.ndarray, int]:
    """The rows' order with those of the largest part in front, given each row's part; and their number."""
    _, at, sizes = np.unique(of, return_inverse=True, return_counts=True)
    return np.argsort(at != np.argmax(sizes), kind="stable"), int(sizes.max())


def _join_sides(parts: list[_Parts], a: _Side, b: _Side, n_a: int, n_b: int, first: int, shift: int, eps_list: list[float]) -> list[tuple]:
    """Join what the rows of ``a`` and of ``b`` connect; the edges ``e, u, v`` that did so, as in ``_join_tile``.

    The first ``n_a`` rows of ``a`` are one part at the smallest radius, so at larger ones as well, and so are the first
    ``n_b`` of ``b``: once these two are connected, their rows are not compared any more.
    """
    found = []
    for left in (slice(0, n_a), slice(n_a, len(a.rid))):
        for right in (slice(0, n_b), slice(n_b, len(b.rid))):
            near, far = a.of_rows(left), b.of_rows(right)
            largest = left.start == right.start == 0
            for tile in _fast_tiles(near, far, False):
                found += _join_tile(parts, tile, near, far, False, first + left.start, shift + right.start, eps_list)
                if largest and all(p.of[first] == p.of[shift] for p in parts):
                    break
    return found


def _joined(rows: DataFrame, b: Blocks, eps_list: list[float]) -> DataFrame:
    """``rows`` with ``parts``: per radius, the smallest id that a row is connected to inside its own block."""
    schema = T.StructType([*rows.schema.fields, T.StructField("parts", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    extra = "core" if "core" in rows.columns else None

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["rid"].to_numpy()))).combine_chunks()
        side = _side(table, extra)
        parts = [_Parts(len(side.rid)) for _ in eps_list]
        runs = [slice(at, min(at + RUN_ROWS, len(side.rid))) for at in range(0, len(side.rid), RUN_ROWS)]
        order, front = [], []
        for own in runs:
            near = side.of_rows(own)
            for tile in _fast_tiles(near, near, True):
                if tile[1].stop > tile[0].start:  # the other half of the square is the same
                    _join_tile(parts, tile, near, near, True, own.start, own.start, eps_list)
            places, n = _largest_first(parts[0].of[own])
            order.append(own.start + places)
            front.append(n)
        if len(runs) > 1:
            order = np.concatenate(order)
            now_at = np.argsort(order)
            side = side.of_rows(order)
            for known in parts:
                known.of = now_at[known.of[order]].astype(np.int32)
            for p, left in enumerate(runs):
                for q in range(p + 1, len(runs)):
                    _join_sides(parts, side.of_rows(left), side.of_rows(runs[q]), front[p], front[q], left.start, runs[q].start, eps_list)
            table = table.take(pa.array(order)).combine_chunks()
        # a part is named by its smallest id
        names = []
        for known in parts:
            least = np.full(len(side.rid), np.iinfo(np.int64).max)
            np.minimum.at(least, known.of, side.rid)
            names.append(least[known.of])
        names = pa.array(np.stack(names, axis=1).ravel())
        ends = pa.array(np.arange(len(side.rid) + 1, dtype=np.int32) * len(eps_list))
        return pa.table([*table.columns, pa.ListArray.from_arrays(ends, names)], names=arrow.names).cast(arrow)

    dealt = rows.repartition(b.n_tasks, *b.scope, "block")
    return materialise(dealt.groupBy(*b.scope, "block").applyInArrow(run, schema), "joined")


def radius_links(c: Collapsed, blocks: Blocks, cores: DataFrame | None, eps_list: list[float], last: bool = False) -> DataFrame:
    """Scope, ``e`` (index into ``eps_list``), ``a > b``: edges that connect the core vectors of every radius exactly.

    ``cores`` has scope, ``rid`` and ``core``, the distance within which a vector has enough points; None: all vectors are
    cores wherever they have a neighbour. At radius ``r`` two cores no further apart than ``r`` are linked. Every block is
    searched on its own first and sends a star per radius and part, fewer edges than it has rows. A pair of blocks knows
    these parts and sends only edges between them, fewer than it has parts; once the two largest are connected, their
    rows are not compared any more. ``eps_list`` ascends. ``last``: nothing reads the blocks' rows after this, so they are deleted.
    """
    schema, arrow = _schemas(c, [("e", T.IntegerType()), ("a", T.LongType()), ("b", T.LongType())])
    n_scope = len(c.scope)
    extra = None if cores is None else "core"

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = [k.as_py() for k in key[:n_scope]]
        a, b = _read_sides(batches, extra)
        if not len(a.rid) or not len(b.rid):  # a block without cores
            return
        (order_a, n_a), (order_b, n_b) = (_largest_first(x.parts[:, 0]) for x in (a, b))
        a, b = a.of_rows(order_a), b.of_rows(order_b)
        names, shift = np.concatenate([a.rid, b.rid]), len(a.rid)
        parts = []
        for e in range(len(eps_list)):
            known = _Parts(len(names))
            for side, start in ((a, 0), (b, shift)):
                _, at, of = np.unique(side.parts[:, e], return_index=True, return_inverse=True)
                known.of[start : start + len(side.rid)] = start + at[of]
            parts.append(known)
        found = [[] for _ in eps_list]
        for e, u, v in _join_sides(parts, a, b, n_a, n_b, 0, shift, eps_list):
            found[e].append((names[u], names[v]))
        for e, edges in enumerate(found):
            if edges:
                u, v = (np.concatenate(x) for x in zip(*edges))
                yield _batch(arrow, scope, [np.full(len(u), e, np.int32), np.maximum(u, v), np.minimum(u, v)])

    rows = blocks.rows.drop("angles")
    rows = _joined(rows if cores is None else rows.join(cores, [*c.scope, "rid"]), blocks, eps_list)
    if last:
        release(blocks.rows)
    inside = rows.select(*c.scope, "rid", F.posexplode("parts").alias("e", "root")).where("rid > root")
    inside = inside.select(*c.scope, "e", F.col("rid").alias("a"), F.col("root").alias("b"))
    return inside.unionByName(_over_pairs(rows, blocks, max(eps_list), run, schema, own=False))
