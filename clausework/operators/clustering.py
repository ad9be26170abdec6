"""Density clusters over cosine neighbourhoods, and cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators import neighbours as N
from clausework.operators.components import connected_components
from clausework.operators.lineage import materialise, release, settle
from clausework.operators.positions import row_position
from clausework.operators.skew import skew_join

NOISE = -1
FEW_RADII = 8  # up to so many are told apart in the search for links; more are cuts of one lightest forest


def cluster_rank(roots: DataFrame, keys: list[str]) -> DataFrame:
    """Number the distinct ``root`` rows of each group 0, 1, … in root order.

    A global position minus the group's first one: no group is sorted in a single task.
    """
    placed = row_position(roots.select(*keys, "root").distinct(), [*keys, "root"], "_at")
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return skew_join(placed, first, keys, salt_by=["root"]).select(
        *keys, "root", (F.col("_at") - F.col("_first")).cast("int").alias("cluster_id")
    )


def levels(eps_list: list[float]) -> Column:
    """``e, eps`` of every radius, as an array."""
    return F.array(*[F.struct(F.lit(i).alias("e"), F.lit(float(x)).alias("eps")) for i, x in enumerate(eps_list)])


def core_distances(c: N.Collapsed, blocks: N.Blocks, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of all vectors: scope, ``rid``, ``core``, and scope, ``rid``, ``core``, ``near``.

    ``core`` is the distance of the ``min_samples``-th point, the vector itself and copies included; null beyond ``eps``.
    ``near`` is the vector's ``near_lists`` entry. A vector that is no core at some radius has all its neighbours there.
    """
    lists = N.near_lists(c, blocks, eps, min_samples)
    reached = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("at")),
        lambda s, x: F.when(s["n"] >= min_samples, s).otherwise(
            F.struct((s["n"] + x["weight"]).alias("n"), x["dist"].alias("at"))
        ),
        lambda s: F.when(s["n"] >= min_samples, s["at"]),
    )
    stored = materialise(lists.withColumn("core", reached), "near")
    return stored.drop("near"), stored


def border_labels(near: DataFrame, core_labels: DataFrame, eps_list: list[float], scope: list[str]) -> DataFrame:
    """Scope, ``rid``, ``e``, ``cluster_id``: the smallest cluster number among the core neighbours of each non-core vector.

    ``near`` is the second table of ``core_distances``; ``core_labels`` has scope, ``rid``, ``e``, ``cluster_id``.
    """
    below = F.filter(levels(eps_list), lambda x: F.col("core").isNull() | (x["eps"] < F.col("core")))
    rows = near.select(*scope, "rid", F.explode(below).alias("x"), "near").select(*scope, "rid", "x.*", F.explode("near").alias("y"))
    rows = rows.where("y.dist <= eps AND y.rid <> rid").select(*scope, F.col("rid").alias("own"), "e", F.col("y.rid").alias("rid"))
    found = skew_join(rows, core_labels, [*scope, "e", "rid"], salt_by=["own"])
    return found.groupBy(*scope, F.col("own").alias("rid"), "e").agg(F.min("cluster_id").alias("cluster_id"))


def dbscan_sweep(
    points: DataFrame,
    eps_list: list[float],
    min_samples: int = 5,
    scope: list[str] = (),
    row_id: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """``scope, eps, id, cluster_id`` of every point for every eps; noise is -1.

    Same labels as a single-machine run on the rows in ``id`` order: a point is core when at least ``min_samples`` points
    (itself included) lie within eps; clusters are the connected cores, numbered by their first core row; a border point
    takes the lowest-numbered cluster next to it. A point without a vector to compare is noise.
    """
    scope = list(scope)
    eps_list = sorted(set(eps_list))
    c = N.collapse_copies(points, scope, row_id, vec)
    blocks = N.place_blocks(c, eps_list[-1])
    release(c.points)
    near = None
    if min_samples > 2 or len(eps_list) > FEW_RADII:
        cores, near = core_distances(c, blocks, eps_list[-1], min_samples)
        found = cores.where("core IS NOT NULL")
    if len(eps_list) > FEW_RADII:
        # every eps is a cut of one forest
        forest = N.reach_forest(c, blocks, found, eps_list[-1])
        cut = F.explode(F.filter(levels(eps_list), lambda x: x["eps"] >= F.col("weight"))["e"])
        links = forest.select(*scope, cut.alias("e"), "a", "b")
    else:
        known = found if near is not None else None
        links = settle(lambda: N.radius_links(c, blocks, known, eps_list, last=True), "links")
    stars = connected_components(links, [*scope, "e"])
    if len(eps_list) <= FEW_RADII:
        release(links)

    if near is None:
        # two points are enough: whoever has a neighbour or a copy is a core, and no point is at a border
        alone = F.filter(levels(eps_list), lambda x: (F.lit(min_samples) <= F.col("weight")) & (F.col("some") | (x["eps"] >= 1)))
        core_rows = c.reps.select(*scope, "rid", F.explode(alone["e"]).alias("e"))
        linked = stars.select(*scope, F.col("node").alias("rid"), "e").unionByName(stars.select(*scope, F.col("root").alias("rid"), "e"))
        core_rows = core_rows.unionByName(linked).distinct()
    else:
        core_rows = cores.select(*scope, "rid", F.explode(F.filter(levels(eps_list), lambda x: x["eps"] >= F.col("core"))["e"]).alias("e"))
    core_roots = materialise(
        core_rows.join(stars.withColumnRenamed("node", "rid"), [*scope, "e", "rid"], "left").select(
            *scope, "rid", "e", F.coalesce("root", "rid").alias("root")
        ),
        "core-roots",
    )
    ranks = cluster_rank(core_roots, [*scope, "e"])
    core_labels = materialise(skew_join(core_roots, ranks, [*scope, "e", "root"], salt_by=["rid"]).drop("root"), "core-labels")
    labelled = core_labels if near is None else core_labels.unionByName(border_labels(near, core_labels, eps_list, scope))

    keyed = c.reps.select(*scope, "rid", "k1", "k2").withColumn(
        "e", F.explode(F.sequence(F.lit(0), F.lit(len(eps_list) - 1)))
    )
    rep_labels = keyed.join(labelled, [*scope, "rid", "e"], "left").select(
        *scope,
        "k1",
        "k2",
        F.element_at(F.array(*[F.lit(float(x)) for x in eps_list]), F.col("e") + 1).alias("eps"),
        F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"),
    )
    members = skew_join(c.members.where("sound"), rep_labels, [*scope, "k1", "k2"], salt_by=["id"])
    every_eps = F.explode(F.array(*[F.lit(float(x)) for x in eps_list])).alias("eps")
    alone = c.members.where("NOT sound").select(*scope, every_eps, "id", F.lit(NOISE).alias("cluster_id"))
    return members.select(*scope, "eps", "id", "cluster_id").unionByName(alone)


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, scope: list[str] = (), row_id: str = "id", vec: str = "vec") -> DataFrame:
    """``scope, id, cluster_id`` of every point for one eps."""
    return dbscan_sweep(points, [eps], min_samples, scope, row_id, vec).drop("eps")


def cluster_sizes(labels: DataFrame, keys: list[str], include_noise: bool = False, reference_sizes: bool = False) -> DataFrame:
    """``keys, cluster_id, size``. With ``reference_sizes`` the first member counts twice, as in older output files."""
    rows = labels if include_noise else labels.where(F.col("cluster_id") != NOISE)
    size = F.count("*") + (1 if reference_sizes else 0)
    return rows.groupBy(*keys, "cluster_id").agg(size.cast("long").alias("size"))


def cluster_size_between(sizes: DataFrame, lo: int = 2, hi: int = 1000) -> DataFrame:
    """Clusters with ``lo < size < hi``."""
    return sizes.where((F.col("size") > lo) & (F.col("size") < hi))


def collect_clusters(members: DataFrame, sizes: DataFrame, keys: list[str], order: str = "id", text: str = "paragraph") -> DataFrame:
    """``keys, cluster_id, size, ids, paragraphs`` of the clusters listed in ``sizes``, members in row order.

    Pass sizes that went through ``cluster_size_between``: the array of a cluster is then bounded by ``hi``, and a huge
    cluster or the noise is dropped before its rows are gathered. The full membership is the ``members`` table itself.
    """
    return gather_clusters(skew_join(members, sizes, [*keys, "cluster_id"], salt_by=[order]), keys, order, text)


def gather_clusters(kept: DataFrame, keys: list[str], order: str = "id", text: str = "paragraph") -> DataFrame:
    """The rows of ``collect_clusters``, given the members of the listed clusters with their cluster's ``size``."""
    group = [*keys, "cluster_id"]
    gathered = kept.groupBy(*group, "size").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_m"))
    return gathered.select(*group, "size", F.col(f"_m.{order}").alias("ids"), F.col(f"_m.{text}").alias("paragraphs"))


def members_with_repeat(clusters: DataFrame) -> DataFrame:
    """The first member twice, as in older output files."""
    return clusters.withColumn("paragraphs", F.concat(F.slice("paragraphs", 1, 1), F.col("paragraphs")))
