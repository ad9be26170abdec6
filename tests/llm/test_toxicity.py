"""Ordinal regression: gradient, held-out accuracy, odd rows."""

import numpy as np

from clausework.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    rows = tox._Rows([rng.integers(0, 50, 6) for _ in range(40)], [rng.random(6) for _ in range(40)], rng.random(40))
    grades = rng.integers(0, 4, 40)
    x = np.r_[rng.normal(size=50) * 0.1, -0.5, 0.2, -0.3]
    _, g = tox._loss(rows, grades, 4, x)
    for at in (*rng.integers(0, 50, 5), 50, 51, 52):
        step = np.zeros_like(x)
        step[at] = 1e-5
        slope = (tox._loss(rows, grades, 4, x + step)[0] - tox._loss(rows, grades, 4, x - step)[0]) / 2e-5
        assert abs(slope - g[at]) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    scored = tox.toxicity(docs, train).join(held, "doc_id").select("toxic", "rejected", "severity").toPandas()
    toxic = scored[scored.toxic == 1]
    clean = scored[scored.toxic == 0]
    assert len(toxic) > 50 and toxic.rejected.mean() > 0.9 and clean.rejected.mean() < 0.01
    assert toxic.severity.mean() > 1.0 > 0.1 > clean.severity.mean()


def test_graded_labels_and_order_of_grades(spark):
    words = ["fine day", "rude word", "rude vile word", "rude vile awful word"]
    docs = spark.createDataFrame([(i, f"{words[i % 4]} text {i % 7}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.severity for r in tox.toxicity(docs, labels).collect()}
    means = [np.mean([got[i] for i in range(g, 400, 4)]) for g in range(4)]
    assert np.allclose(means, range(4), atol=0.3)


def test_odd_rows_and_no_model(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", None), (2, "", "b")], "doc_id long, text string, row string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {tuple(r) for r in tox.toxicity(docs, none).collect()} == {(1, 0.0, 0.0, False), (2, 0.0, 0.0, False), (None, 0.0, 0.0, False)}
    assert tox.clean(docs, none).count() == 4 and tox.clean(docs, none).columns == docs.columns
    assert tox.toxicity(docs.limit(0), none).collect() == []


def test_a_batch_is_scored_text_by_text():
    """The features of 1,500 texts would take some 40 MB together."""
    import tracemalloc

    import pyarrow as pa

    words = " ".join(f"w{i}ordinary" for i in range(300))
    model = tox.OrdinalModel(np.zeros(tox.DIMENSIONS, np.float32), np.array([1.0]))
    texts, places = pa.array([words] * 1500 + [None, ""]), tox._Places()
    tox.score(texts.slice(0, 1), model, places)
    tracemalloc.start()
    severity, p_toxic = tox.score(texts, model, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert len(set(severity[:1500])) == 1 and severity[0] > 0 and list(severity[1500:]) == [0, 0] == list(p_toxic[1500:])


def test_rows_stay_out_of_the_workers(spark):
    """Cleaning sends texts to the Python workers, not whole rows there and back."""
    docs = spark.createDataFrame([(i, "rude word" if i % 2 else "fine day", "x") for i in range(40)], "doc_id long, text string, more string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    kept = tox.clean(docs, labels)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.where("doc_id % 2 = 0").collect())
