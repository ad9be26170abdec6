"""Nearest neighbours: recall against brute force, exact scores, ties and odd vectors."""

import numpy as np

from clausework.llm.ann import Centroids, _unit, fit_centroids, nearest

SF = "/root/testdata/sf0.1"


def brute(ids, rows, queries, k):
    rows = np.array(rows, float)
    norms = np.sqrt((rows**2).sum(axis=1))
    out = {}
    for q in queries:
        at = ids.index(q)
        score = rows @ rows[at] / (norms * norms[at])
        order = sorted((i for i in range(len(ids)) if i != at), key=lambda i: (-round(score[i], 12), ids[i]))[:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, list(r.embedding)) for r in vectors.collect())
    ids = [i for i, _ in rows]
    want = brute(ids, [v for _, v in rows], [i for i in ids if i % 50 == 0], 5)
    got = {}
    for r in nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, found in want.items():
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 5
        scores = dict(found)
        hits += len(set(scores) & {i for i, _ in got[q]})
        assert all(abs(s - scores[i]) < 1e-12 for i, s in got[q] if i in scores)
    assert hits >= 0.9 * 5 * len(want)


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100, [2.0, 4.0, 6.0]), (101, [-1.0, 0.0, 0.5]), (101, [-1.0, 0.0, 0.5])]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (205, []), (206, [1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id IN (0, 3, 100, 101, 201, 202)")
    got = {}
    for r in nearest(vectors, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got[0] == list(enumerate([1, 2, 3, 4, 5], 1))
    assert got[3] == list(enumerate([0, 1, 2, 4, 5], 1))
    assert got[100] == list(enumerate([0, 1, 2, 3, 4], 1))
    assert set(got) == {0, 3, 100, 101} and len(got[101]) == 5


def test_few_or_no_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(vectors, vectors.where("vec_id = 1")).collect()] == [(1, 1, 2, 0.0)]
    assert nearest(vectors.limit(0), vectors).collect() == []
    assert nearest(vectors, vectors.limit(0)).collect() == []


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(5)
    sample = _unit(rng.normal(size=(4000, 16)))
    centroids = fit_centroids(sample, 256)
    assert isinstance(centroids, Centroids) and 200 <= len(centroids.vectors) <= 256
    queries = _unit(rng.normal(size=(50, 16))).astype(np.float32)
    found, _ = centroids.search(queries, 32)
    best = np.argsort(-queries @ centroids.vectors.T, axis=1)[:, :8]
    assert np.mean([len(set(b) & set(f)) / 8 for b, f in zip(best, found)]) > 0.95
