import pytest
from pyspark.sql import functions as F

from clausework.operators import components, skew
from clausework.operators.components import connected_components
from clausework.operators.paragraphs import dataset_stats
from clausework.operators.positions import assign_chunks, assign_splits, latest_wins, row_position, sample_members


@pytest.fixture(scope="module")
def tables(spark):
    fact = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("v")
    )
    dim = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    dim = dim.unionByName(spark.createDataFrame([(7, 70), (7, 71)], "k long, w long"))
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_change_nothing(tables, how):
    fact, dim = tables
    plain = fact.join(dim, ["k"], how)
    salted = skew.skew_join(fact, dim, ["k"], how, rows_per_task=100)
    assert salted.columns == plain.columns
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_hot_key_is_spread(spark, tables):
    fact, dim = tables
    plan = skew.skew_join(fact, dim, ["k"], rows_per_task=100)._jdf.queryExecution().toString()
    assert "_salt" in plan
    no_hot = skew.skew_join(spark.range(5000).withColumnRenamed("id", "k"), dim, ["k"], rows_per_task=100)
    assert "_salt" not in no_hot._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_key_columns_only_and_null_keys(spark, how):
    fact = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"))
    dim = spark.createDataFrame([(5,), (7,), (None,)], "k long")
    salted = skew.skew_join(fact, dim, ["k"], how, rows_per_task=100)
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, fact.join(dim, ["k"], how).collect()), key=repr)


def test_splits_and_statistics_are_the_same_when_salted(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("source").alias("url"))
    plain = {tuple(r) for r in assign_splits(docs, "url", 7).collect()}
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)  # 20 sources of 50 rows each: every one is hot
    salted = assign_splits(docs, "url", 7)
    assert "_salt" in salted._jdf.queryExecution().toString() and {tuple(r) for r in salted.collect()} == plain
    assert sum(r["n_rows"] for r in dataset_stats(salted).collect()) == 1000


def test_positions_on_ties_and_many_partitions(spark):
    rows = [(i % 7, i) for i in range(5000)]
    for parts in (1, 13):
        df = spark.createDataFrame(rows, "a int, b int").repartition(parts)
        got = [(r["a"], r["b"]) for r in row_position(df, [F.desc("a"), "b"]).orderBy("pos").collect()]
        assert got == sorted(rows, key=lambda r: (-r[0], r[1]))
        assert [r["pos"] for r in row_position(df, [F.desc("a"), "b"]).orderBy("pos").collect()] == list(range(5000))
    assert row_position(spark.range(0), ["id"]).count() == 0


def test_chunks(spark):
    sizes = assign_chunks(spark.range(1000), ["id"], 7).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [143] * 6 + [142]
    few = assign_chunks(spark.range(3), ["id"], 7).groupBy("chunk").count().collect()
    assert len(few) == 3


def test_chunks_within_groups(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("split"), "id")
    placed = assign_chunks(df, ["id"], 4, within=["split"])
    sizes = {(r["split"], r["chunk"]): r["count"] for r in placed.groupBy("split", "chunk").count().collect()}
    assert sizes == {(0, 0): 9, (0, 1): 9, (0, 2): 9, (0, 3): 7, **{(s, c): n for s in (1, 2) for c, n in enumerate([9, 9, 9, 6])}}
    assert placed.where("split = 1 AND id = 4").first()["pos"] == 1


def test_sample_ignores_row_order(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    one = {tuple(r) for r in sample_members(df, ["g"], "id", 20, seed=1).collect()}
    two = {tuple(r) for r in sample_members(df.repartition(11).orderBy(F.rand()), ["g"], "id", 20, seed=1).collect()}
    assert one == two and len(one) == 40
    assert one != {tuple(r) for r in sample_members(df, ["g"], "id", 20, seed=2).collect()}


def test_slug_collision_keeps_the_last(spark):
    df = spark.createDataFrame([(1, "a_b", 5, "old"), (2, "a_b", 9, "new"), (3, "c", 1, "x")], "id int, slug string, at int, html string")
    assert sorted(r["html"] for r in latest_wins(df, ["slug"], ["at"], "id").collect()) == ["new", "x"]


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in parent if find(x) != x}


@pytest.mark.parametrize("vertices", [0, 40, 10**6])
def test_components(spark, monkeypatch, vertices):
    """With no room to contract in, the rounds alone must do it."""
    monkeypatch.setattr(components, "CONTRACT_VERTICES", vertices)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 20 if vertices == 0 else 10**6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    path = [(i + 1, i) for i in range(60)]
    hub = [(1000 + i, 999) for i in range(300)] + [(999, 998), (5000, 1299)]
    ring = [(7001, 7000), (7002, 7001), (7003, 7002), (7003, 7000)]
    zigzag = [(9000, 8000), (9000, 8500), (9100, 8500), (9100, 8200)]
    rows = path + hub + ring + zigzag
    edges = spark.createDataFrame([(g, a, b) for g in (0, 1) for a, b in rows if g == 0 or a < 2000], "g int, a long, b long")
    got = {tuple(r) for r in connected_components(edges, ["g"]).collect()}
    expected = {(0, *p) for p in union_find(rows)} | {(1, *p) for p in union_find([r for r in rows if r[0] < 2000])}
    assert got == expected
    assert connected_components(edges.limit(0), ["g"]).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """However many partitions the edges come in: tasks are as many as the edges fill."""

    def refused(*_):
        raise AssertionError("a round")

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(components, "_large_star", refused)
        edges = spark.createDataFrame([(i + 1, i) for i in range(500)], "a long, b long").repartition(40)
        assert {tuple(r) for r in connected_components(edges, []).collect()} == {(i, 0) for i in range(1, 501)}
        monkeypatch.undo()
        monkeypatch.setattr(components, "EDGES_PER_TASK", 100)
        assert {tuple(r) for r in connected_components(edges, []).collect()} == {(i, 0) for i in range(1, 501)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
