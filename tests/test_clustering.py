"""Density clusters against a brute-force NumPy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.functions import vectors
from clausework.operators import clustering as C
from clausework.operators import neighbours as N
from clausework.operators import skew
from clausework.operators.embedding import embed, hashing_encoder
from clausework.operators.labels import sample_texts
from clausework.operators.positions import sample_members
from clausework.plans import clusters as CL


def brute(vectors, eps, min_samples):
    v = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    norm = np.sqrt((v * v).sum(1))
    u = v / np.where(norm > 0, norm, 1)[:, None]
    near = 1 - u @ u.T <= eps
    np.fill_diagonal(near, np.where(norm > 0, True, 1 <= eps))
    core = near.sum(1) >= min_samples
    labels = np.full(len(v), -1)
    current = 0
    for i in range(len(v)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            if labels[p] != -1:
                continue
            labels[p] = current
            if core[p]:
                stack.extend(j for j in np.flatnonzero(near[p]) if labels[j] == -1)
        current += 1
    return labels


def frame(spark, vectors, groups=None):
    rows = [(int(groups[i]) if groups is not None else 0, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "g int, id long, vec array<float>").repartition(5)


def blobs(seed, n=260, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.12, 0.5], size=(n, 1))
    v[rng.integers(0, n, n // 3)] = v[0]  # a third are copies
    v[5] = v[50] = 0.0
    return v


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "MIN_BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "TILE_ROWS", 16)
    monkeypatch.setattr(N, "STRIP_ROWS", 24)
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 40)
    if seed == 2:
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    v = blobs(seed)
    eps_list = [0.02, 0.06, 0.15]
    got = C.dbscan_sweep(frame(spark, v), eps_list, 5, ["g"]).collect()
    kinds = set()
    for eps in eps_list:
        labels = {r["id"]: r["cluster_id"] for r in got if r["eps"] == eps}
        expected = brute(v, eps, 5)
        assert [labels[i] for i in range(len(v))] == list(expected)
        kinds.add(len(set(expected)))
        assert -1 in expected
    assert len(kinds) > 1


@pytest.mark.parametrize("min_samples", [1, 2])
def test_two_points_need_one_pass(spark, monkeypatch, min_samples):
    """With up to two points to a core no vector's nearest are asked for: the links alone say who is a core."""

    def never(*_):
        raise AssertionError("a pass too many")

    monkeypatch.setattr(C, "core_distances", never)
    monkeypatch.setattr(N, "MIN_BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 40)
    v = blobs(7)
    eps_list = [0.02, 0.15]
    got = C.dbscan_sweep(frame(spark, v), eps_list, min_samples, ["g"]).collect()
    for eps in eps_list:
        labels = {r["id"]: r["cluster_id"] for r in got if r["eps"] == eps}
        assert [labels[i] for i in range(len(v))] == list(brute(v, eps, min_samples))


def test_many_radii_are_cuts_of_one_forest(spark, monkeypatch):
    v = blobs(8, n=120)
    few = C.dbscan_sweep(frame(spark, v), [0.02, 0.06, 0.15], 5, ["g"]).collect()
    monkeypatch.setattr(C, "FEW_RADII", 2)
    assert sorted(few) == sorted(C.dbscan_sweep(frame(spark, v), [0.02, 0.06, 0.15], 5, ["g"]).collect())


def test_links_of_a_dense_region_are_a_forest_per_radius(spark):
    rng = np.random.default_rng(0)
    v = np.ones((1500, 4)) + rng.normal(size=(1500, 4)) * 1e-3
    c = N.collapse_copies(frame(spark, v), [])
    blocks = N.place_blocks(c)
    links = N.radius_links(c, blocks, None, [0.05, 0.1]).groupBy("e").count().collect()
    pairs = N.block_pairs(blocks, 0.1).count()
    assert {r["e"] for r in links} == {0, 1}
    assert all(1499 <= r["count"] <= 2 * 1500 * pairs / blocks.bounds.count() for r in links)


def test_pairs_of_blocks_do_not_send_what_a_block_has_connected(spark, monkeypatch):
    """A dense region in many blocks: an edge per row from the blocks, and one per pair of them."""
    monkeypatch.setattr(N, "MIN_BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 100)
    rng = np.random.default_rng(0)
    v = np.ones((1500, 4)) + rng.normal(size=(1500, 4)) * 1e-3
    c = N.collapse_copies(frame(spark, v), [])
    blocks = N.place_blocks(c)
    links = N.radius_links(c, blocks, None, [0.05, 0.1]).groupBy("e").count().collect()
    n_blocks, pairs = blocks.bounds.count(), N.block_pairs(blocks, 0.1).count()
    assert n_blocks >= 15 and {r["count"] for r in links} == {1500 - n_blocks + pairs - n_blocks} and len(links) == 2


def test_scopes_do_not_mix_and_order_does_not_matter(spark):
    v = blobs(3)
    g = np.arange(len(v)) % 2
    df = frame(spark, v, g)
    one = {(r["g"], r["id"]): r["cluster_id"] for r in C.dbscan(df, 0.06, 5, ["g"]).collect()}
    two = {(r["g"], r["id"]): r["cluster_id"] for r in C.dbscan(df.orderBy(F.rand(3)).coalesce(1), 0.06, 5, ["g"]).collect()}
    assert one == two
    for scope in (0, 1):
        expected = brute(v[g == scope], 0.06, 5)
        ids = np.flatnonzero(g == scope)
        assert [one[(scope, i)] for i in ids] == list(expected)


def test_small_geometry(spark):
    """Two clusters, a border point between them, a copy, noise and a zero vector."""

    def at(degrees):
        a = np.radians(degrees)
        return [np.cos(a), np.sin(a), 0.0]

    v = [at(d) for d in (0, 1, 2, 3, 4, 4)] + [at(8)] + [at(d) for d in (16, 15, 14, 13, 12)] + [[0, 0, 1.0], [0, 0, 0]]
    eps = 1 - np.cos(np.radians(4.5))
    got = {r["id"]: r["cluster_id"] for r in C.dbscan(frame(spark, v), eps, 5).collect()}
    expected = list(brute(v, eps, 5))
    assert [got[i] for i in range(len(v))] == expected
    assert expected[6] == 0 and expected[7] == 1 and expected[-2:] == [-1, -1]


def test_dense_region_sends_no_pairs(spark):
    """2,000 near copies: the pairs would be two million; the forest has fewer edges than rows per block pair."""
    rng = np.random.default_rng(0)
    v = np.ones((2000, 4)) + rng.normal(size=(2000, 4)) * 1e-3
    c = N.collapse_copies(frame(spark, v), [])
    blocks = N.place_blocks(c)
    cores, near = C.core_distances(c, blocks, 0.1, 5)
    forest = N.reach_forest(c, blocks, cores, 0.1)
    pairs = N.block_pairs(blocks, 0.1).count()
    assert 1999 <= forest.count() <= 2 * 2000 * pairs / blocks.bounds.count()
    assert near.agg(F.min(F.size("near")), F.max(F.size("near"))).first() == (5, 5)
    assert N.neighbour_counts(c, blocks, [0.1]).agg(F.min("n"), F.max("n")).first() == (2000, 2000)
    assert {r["cluster_id"] for r in C.dbscan(frame(spark, v), 0.1).collect()} == {0}


def apart(seed, groups=8, each=60, dim=16):
    """Groups around axes at right angles, and a zero vector."""
    rng = np.random.default_rng(seed)
    v = np.repeat(np.eye(dim)[:groups], each, axis=0) + rng.normal(size=(groups * each, dim)) * 0.02
    return np.concatenate([v, np.zeros((1, dim))])


@pytest.mark.parametrize("eps", [0.05, 1.0])
def test_blocks_that_lie_apart_are_not_compared(spark, monkeypatch, eps):
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 30)
    v = apart(4)
    df = frame(spark, v)
    c = N.collapse_copies(df, [])
    blocks = N.place_blocks(c)
    n = blocks.bounds.count()
    assert blocks.bounds.agg(F.max("n"), F.sum("n")).first() == (30, len(v)) or blocks.bounds.agg(F.max("n")).first()[0] <= 30
    compared = N.block_pairs(blocks, eps).count()
    if eps < 1:
        assert n >= 17 and compared <= n * (n + 1) / 2 / 3
    unit = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-30)[:, None]
    dist = 1 - unit.astype(np.float32).astype(np.float64) @ unit.astype(np.float32).astype(np.float64).T
    got = {(r["id_a"], r["id_b"]) for r in N.eps_neighbours(df, eps).collect()}
    i, j = np.nonzero(np.triu(dist <= eps - 1e-5, 1))
    assert set(zip(i.tolist(), j.tolist())) <= got
    assert all(dist[a, b] <= eps + 1e-5 for a, b in got)
    labels = {r["id"]: r["cluster_id"] for r in C.dbscan(df, eps).collect()}
    assert [labels[x] for x in range(len(v))] == list(brute(v, eps, 5))


def test_a_small_scope_is_not_cut_like_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(520, 6))
    groups = np.where(np.arange(520) < 500, 0, 1 + np.arange(520) % 4)
    c = N.collapse_copies(frame(spark, v, groups), ["g"])
    blocks = {r["g"]: r["n"] for r in N.place_blocks(c).bounds.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert blocks[0] >= 10 and all(blocks[g] == 1 for g in range(1, 5))


@pytest.mark.parametrize("seed", [5, 6])
def test_every_cut_of_the_forest_is_a_clustering(spark, monkeypatch, seed):
    """The forest of a large radius, cut at any smaller one, joins the cores that brute force joins."""
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 60)
    monkeypatch.setattr(N, "STRIP_ROWS", 25)
    v = blobs(seed, n=220)
    c = N.collapse_copies(frame(spark, v), [])
    blocks = N.place_blocks(c)
    cores, _ = C.core_distances(c, blocks, 0.3, 4)
    core = {r["rid"]: r["core"] for r in cores.where("core IS NOT NULL").collect()}
    edges = [tuple(r) for r in N.reach_forest(c, blocks, cores.where("core IS NOT NULL"), 0.3).collect()]
    members = {r["id"]: r["rid"] for r in N.members_of(c).collect()}
    for eps in (0.01, 0.05, 0.13, 0.3):
        root = {x: x for x in core if core[x] <= eps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, w in edges:
            if w <= eps:
                root[max(find(a), find(b))] = min(find(a), find(b))
        expected = brute(v, eps, 4)
        got = {}
        for i, rid in members.items():
            if rid in root:
                got.setdefault(find(rid), set()).add(int(expected[i]))
        assert all(len(x) == 1 and -1 not in x for x in got.values())
        assert len(got) == len(set(expected) - {-1})


def test_prim_and_kruskal_agree():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 12, 2)
        w = rng.integers(1, 9, (n, m)) / 4.0
        w[rng.random((n, m)) < 0.4] = np.inf
        a, b, total = N._prim(w, slice(0, int(n)), slice(int(n), int(n + m)), int(n + m))
        i, j = np.nonzero(np.isfinite(w))
        kept = N._kruskal(i, n + j, w[i, j])
        assert len(kept) == len(a) == len(b) and np.isclose(sum(total), w[i, j][kept].sum())


def test_copies_are_one_row(spark):
    v = [[1.0, 0.0]] * 400 + [[0.0, 1.0]] * 200 + [[0.9, 0.1]]
    rows = N.eps_neighbours(frame(spark, v), 0.05).orderBy("id_a", "id_b").collect()
    assert [(r["id_a"], r["id_b"], r["copies_a"], r["copies_b"]) for r in rows] == [(0, 0, 400, 400), (0, 600, 400, 1), (400, 400, 200, 200)]
    flags = N.core_flags(frame(spark, v), 0.05)
    assert {(r["n_neighbours"], r["n"]) for r in flags.groupBy("n_neighbours").agg(F.count("*").alias("n")).collect()} == {(401, 401), (200, 200)}


def test_layout(spark):
    """Large blocks where scopes are many, more of them where one scope must fill the cores, bounded by memory."""

    def blocks(rows, slots):
        sizes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "scope int, n long, d int")
        work = float(sum(n * n for n, _ in rows))
        return [r["n_blocks"] for r in N.blocks_per_scope(sizes, slots, work).orderBy("scope").collect()]

    assert blocks([(5_000, 1024)] * 500, 8) == [1] * 500
    (one,) = blocks([(100_000, 1024)], 8)
    assert 100_000 / one <= N.MAX_BLOCK_ROWS
    assert blocks([(2000, 64)], 8) == [6] and blocks([(2000, 64), (100, 64)], 8) == [6, 1]
    assert blocks([(10**6, 100_000)], 8)[0] >= 10**6 * 4 * 100_000 // N.MAX_BLOCK_BYTES


def test_no_points(spark):
    assert C.dbscan(frame(spark, [[1.0, 0.0]]).limit(0), 0.1).count() == 0
    assert [r["cluster_id"] for r in C.dbscan(frame(spark, [[1.0, 0.0]]), 0.1).collect()] == [-1]


def test_collecting_respects_the_bounds(spark):
    rows = [(0, i, f"a{i}") for i in range(30)] + [(1, 100 + i, f"b{i}") for i in range(4)] + [(2, 200 + i, f"c{i}") for i in range(2)] + [(-1, 300 + i, "n") for i in range(9)]
    members = spark.createDataFrame(rows, "cluster_id int, id long, paragraph string").repartition(4)
    got = {r["cluster_id"]: r["paragraphs"] for r in CL.bounded_clusters(members, [], 2, 30).collect()}
    assert got == {1: ["b0", "b1", "b2", "b3"]}
    assert set(r["cluster_id"] for r in CL.bounded_clusters(members, [], 2, 31, include_noise=True).collect()) == {0, 1, -1}
    doubled = CL.bounded_clusters(members, [], 2, 30, reference_sizes=True)
    assert {r["cluster_id"]: r["size"] for r in doubled.collect()} == {1: 5, 2: 3}
    assert C.members_with_repeat(doubled).where("cluster_id = 2").first()["paragraphs"] == ["c0", "c0", "c1"]


def test_sample_inside_the_row_equals_the_window(spark):
    rows = [(0, i, f"a{i}") for i in range(50)] + [(1, 100 + i, f"b{i}") for i in range(4)]
    members = spark.createDataFrame(rows, "cluster_id int, id long, paragraph string")
    collected = CL.bounded_clusters(members, []).select("cluster_id", F.explode(sample_texts(6, 3)).alias("paragraph"))
    window = sample_members(members, ["cluster_id"], "id", 6, 3).select("cluster_id", "paragraph")
    assert sorted(map(tuple, collected.collect())) == sorted(map(tuple, window.collect()))


def test_encoder(spark):
    df = spark.createDataFrame([("a a b",), ("",), ("A A B",)], "paragraph string")
    rows = [np.array(r["vec"]) for r in embed(df, hashing_encoder(32)).collect()]
    assert np.isclose(np.linalg.norm(rows[0]), 1) and not rows[1].any() and np.allclose(rows[0], rows[2])


def test_copies_only_nulls_and_lengths(spark):
    schema = "id long, vec array<float>"
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)] + [(9, [-1.0, 0.5])], schema)
    assert [tuple(r) for r in N.eps_neighbours(copies, 0.1).collect()] == [(0, 0, 0.0, 3, 3)]
    assert {tuple(r) for r in N.copy_members(copies).collect()} == {(0, 0), (1, 0), (2, 0), (9, 9)}
    odd = copies.unionByName(spark.createDataFrame([(20, None), (21, [1.0, None]), (22, [])], schema))
    labels = {r["id"]: r["cluster_id"] for r in C.dbscan(odd, 0.1, 3).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 9: -1, 20: -1, 21: -1, 22: -1}
    assert {r["id"]: r["n_neighbours"] for r in N.core_flags(odd, 0.1).collect()}[20] == 0
    with pytest.raises(ValueError, match="different lengths"):
        N.eps_neighbours(copies.unionByName(spark.createDataFrame([(30, [1.0])], schema)), 0.1)


def test_pivots_that_tell_little_apart_are_not_used(spark, monkeypatch):
    """Vectors spread over a cone are cut by a hash, as blocks along pivots would all meet; tight groups by pivots."""
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    spread = rng.random((400, 8)) + 0.2
    groups = np.eye(8)[rng.integers(0, 8, 400)] + rng.random((400, 8)) * 0.01
    for vectors, eps, used in ((spread, 0.25, False), (groups, 0.05, True)):
        points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<float>")
        blocks = N.place_blocks(N.collapse_copies(points, []), eps)
        assert blocks.bounds.where("lo IS NOT NULL").isEmpty() != used and blocks.bounds.count() >= 10
        unit = vectors.astype(np.float32).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        near = np.argwhere(np.triu(1 - unit @ unit.T <= eps, 1))
        assert {(r["id_a"], r["id_b"]) for r in N.eps_neighbours(points, eps).collect()} == set(map(tuple, near.tolist()))


def test_hits_are_those_of_nonzero():
    rng = np.random.default_rng(6)
    for shape in ((1, 1), (3, 5), (16, 128), (7, 2047), (2, 0)):
        for share in (0.0, 0.01, 0.7):
            flags = rng.random(shape) < share
            assert all((a == b).all() for a, b in zip(N._hits(flags), np.nonzero(flags)))


def test_distances_of_near_pairs_are_not_joined(spark):
    """Pairs with their distances as they are found; an id that names several vectors has a distance for each."""
    from workload.registry import near_distances

    rng = np.random.default_rng(8)
    one = [(i, v.tolist()) for i, v in enumerate(rng.random((60, 6)) + 0.1)]
    several = [*one, *one[:5], (7, one[30][1]), (None, one[3][1]), (70, [0.0] * 6), (71, None)]
    for rows in (one, several):
        points = spark.createDataFrame(rows, "id long, vec array<float>")
        got = near_distances(points, 0.05)
        pairs = N.eps_neighbours(points, 0.05).select("id_a", "id_b")
        pairs = pairs.unionByName(points.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))).distinct()
        sides = [points.select(F.col("id").alias(f"id_{s}"), F.col("vec").alias(f"vec_{s}")) for s in "ab"]
        dist = F.round(vectors.cosine_distance(F.col("vec_a"), F.col("vec_b")), 6).alias("dist")
        want = pairs.join(sides[0], "id_a").join(sides[1], "id_b").select("id_a", "id_b", dist)
        key = lambda r: (r[0], r[1], r[2] is None, r[2])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.count() > 100
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") - N.eps_neighbours(points, 0.05)._jdf.queryExecution().optimizedPlan().toString().count("Join") == (1 if rows is one else 3)


@pytest.mark.parametrize("twice", [False, True])
def test_every_copy_of_a_vector_has_its_pairs(spark, tmp_path, twice):
    """Near pairs of ids against the SQL, where many ids share a vector; a row that comes twice has each of its pairs twice."""
    from tests.oracle import connect, spark_result, sql_result
    from workload.oracles import ORACLES
    from workload.registry import QUERIES

    rng = np.random.default_rng(9)
    v = rng.normal(size=(12, 8))[rng.integers(0, 12, 60)].astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v) if i % 7]
    rows += rows[:3] * twice
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    columns, got = spark_result(QUERIES["cosine_distance"](spark, str(tmp_path)))
    own = [r for r in got if r[columns.index("id_a")] == r[columns.index("id_b")]]
    assert len(own) == (12 if twice else 0)  # both rows of an id are near each other, which the SQL leaves out
    assert [r for r in got if r not in own] == sql_result(connect(str(tmp_path)), ORACLES["cosine_distance"])[1]


def test_pairs_of_many_blocks_meet_in_waves(spark, monkeypatch):
    """Copies of blocks are made for some of the pairs at a time; the results are those of all pairs at once."""
    monkeypatch.setattr(N, "MIN_BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "MAX_BLOCK_ROWS", 30)
    monkeypatch.setattr(N, "WAVE_BYTES", 1)
    written, whole = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, label, *rest: (written.append(label), whole(df, label, *rest))[1])
    v = blobs(11)
    df = frame(spark, v)
    got = {r["id"]: r["cluster_id"] for r in C.dbscan_sweep(df, [0.06], 2).collect()}
    assert [got[i] for i in range(len(v))] == list(brute(v, 0.06, 2)) and written.count("wave") > 1
    c = N.collapse_copies(df, [])
    blocks = N.place_blocks(c, 0.06)
    rid = {r["id"]: r["rid"] for r in N.members_of(c).collect()}
    unit = v.astype(np.float32).astype(np.float64)
    unit /= np.maximum(np.linalg.norm(unit, axis=1), 1e-30)[:, None]
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, 9)
    near = {r["rid"]: (r["n"], r["nearest"]) for r in N.near_counts(c, blocks, 0.06).collect()}
    for i in range(len(v)):
        n, nearest = near.get(rid[i], (0, None))
        assert n == (dist[i] <= 0.06).sum() and (n == 0 or abs(nearest - max(0, dist[i].min())) < 1e-9)


def test_runs_of_a_block_are_joined(spark, monkeypatch):
    """A block of several runs: each row's part is that of all its rows, named by the smallest id."""
    monkeypatch.setattr(N, "RUN_ROWS", 37)
    monkeypatch.setattr(N, "MIN_BLOCK_ROWS", 1000)
    v = blobs(12)
    got = C.dbscan_sweep(frame(spark, v), [0.02, 0.15], 2).collect()
    for eps in (0.02, 0.15):
        labels = {r["id"]: r["cluster_id"] for r in got if r["eps"] == eps}
        assert [labels[i] for i in range(len(v))] == list(brute(v, eps, 2))


def test_only_the_last_tables_of_the_splits_stay(spark):
    """Tables on the way to the labels are deleted with the shuffles behind them, and one table holds the texts."""
    import os
    from clausework.operators.lineage import _job_folder

    folder = _job_folder(spark)
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    rows = [(f"s{i % 9}", i, j, f"word{i % 5} and {j % 3} more") for i in range(60) for j in range(5)]
    rows += rows[:7]  # rows that come twice
    paragraphs = spark.createDataFrame(rows, "url string, page_key long, pos int, paragraph string")
    placed, labels = CL.cluster_splits(paragraphs, hashing_encoder(), [0.25], 3, 2, 2)
    left = sorted(x[:-33] for x in set(os.listdir(folder)) - before)
    assert left == ["labels", "paragraphs", "placed"]
    assert labels.count() == placed.count() == len(rows)
    assert sorted(placed.columns) == sorted(["split", "chunk", "id", "url", "page_key", "line", "paragraph"])
    per_split = [r for r in placed.orderBy("split", "id").collect()]
    for split in {r["split"] for r in per_split}:
        own = [r for r in per_split if r["split"] == split]
        assert [r["id"] for r in own] == list(range(len(own)))
        assert [(r["url"], r["page_key"], r["line"]) for r in own] == sorted((r["url"], r["page_key"], r["line"]) for r in own)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
