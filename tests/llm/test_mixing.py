"""Raking and sampling: marginals, both ways of raking, odd rows, plan."""

import pytest

from clausework.llm import mixing
from clausework.llm.mixing import mix, rake

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("one_task", [50_000, 0])
def test_marginals_meet_their_targets(spark, monkeypatch, one_task):
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", one_task)
    cells = spark.createDataFrame(
        [(s, x, t, (i * 37) % 11 + 1) for i, (s, x, t) in enumerate((s, x, t) for s in "abcd" for x in "xy" for t in "pqr")],
        "source string, lang string, topic string, tokens long",
    )
    total = sum(r.tokens for r in cells.collect())
    shares = {"source": dict(zip("abcd", (0.1, 0.2, 0.3, 0.4))), "lang": {"x": 0.9, "y": 0.1}, "topic": dict(zip("pqr", (0.2, 0.3, 0.5)))}
    targets = {d: spark.createDataFrame([(c, v * total) for c, v in s.items()], f"{d} string, target double") for d, s in shares.items()}
    fitted = rake(cells, targets).toPandas()
    for d, s in shares.items():
        got = fitted.groupby(d).fitted.sum() / total
        assert all(abs(got[c] - v) < 1e-6 for c, v in s.items())
    # the odds ratios of the observed table stay
    assert len(fitted) == cells.count()


def test_expected_tokens_follow_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mix(docs, rate=3.0).toPandas()
    tokens = (got.n_tokens * got.copies).groupby(got.lang).sum()
    own = docs.select("lang", mixing.n_tokens(docs.text).alias("n")).groupBy("lang").sum("n").toPandas().set_index("lang")["sum(n)"]
    want = own**0.7 / (own**0.7).sum()
    assert all(abs(tokens[x] / tokens.sum() - want[x]) < 0.05 for x in want.index)


def test_odd_rows(spark):
    rows = [(None, None, None, None, 7), (1, "", "en", "s", 8), (1, "", "en", "s", 8), (2, "a b c", "en", "s", 9), (3, "word " * 9_000, "", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int")
    got = mix(docs, rate=2.0)
    assert set(docs.columns) | {"topic", "n_tokens", "copies"} == set(got.columns)
    assert {r.doc_id for r in got.collect()} <= {None, 1, 2, 3} and got.where("copies < 1").count() == 0
    assert got.where("doc_id = 1").count() in (0, 2)
    assert mix(docs.limit(0)).collect() == []


def test_native_plan(spark):
    plan = mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


@pytest.mark.parametrize("one_task", [50_000, 0])
def test_documents_get_their_cells_weight_either_way(spark, monkeypatch, one_task):
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", one_task)
    monkeypatch.setattr("clausework.operators.skew.ROWS_PER_TASK", 10)
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "en", "word " * (i % 5 + 1)) for i in range(120)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = sorted(((r.doc_id, r.weight, r.copies) for r in mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 50_000)
    assert got == sorted(((r.doc_id, r.weight, r.copies) for r in mix(docs).collect()), key=repr) and len(got) > 60


def test_raking_that_cannot_settle_says_so(spark):
    cells = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "source string, lang string, tokens long")
    tables = {d: spark.createDataFrame(t, f"{d} string, target double") for d, t in (("source", [("a", 9.0), ("b", 1.0)]), ("lang", [("x", 1.0), ("y", 9.0)]))}
    with pytest.warns(UserWarning, match="not settled"):
        rake(cells, tables, rounds=4)
