"""Benchmark decontamination against brute force."""

import collections
import random

import pytest

from clausework.llm import decontam
from clausework.llm.decontam import clean, leaks


def words(text):
    return (text or "").encode().lower().split()


def grams(ws, width):
    return [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]


def brute(docs, items, size=5, similarity=0.8):
    found = {}
    for i, text in docs:
        ws = words(text)
        for j, item in items:
            it = words(item)
            if not it:
                continue
            width = min(size, len(it))
            want = collections.Counter(grams(it, width))
            for start in range(len(ws) - len(it) + 1):
                have = collections.Counter(grams(ws[start : start + len(it)], width))
                value = sum((want & have).values()) / sum((want | have).values())
                if value >= similarity and (value, -start) > found.get((i, text, j), (0, 0))[:2]:
                    found[i, text, j] = (value, -start, len(it))
    return {(i, j, -back, n, round(v, 6)) for (i, _, j), (v, back, n) in found.items()}


def some_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(n))) for j, n in enumerate([3, 1, 5, 12, 12, 20, 35])]
    items += [(50, None), (51, " \t"), (52, "A b A b A b a b a b a b")]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 2:
            held = rng.choice(items)[1] or ""
            held = held.upper().split()
            if i % 4 == 1 and held:
                held[-1] = "changed"
            text[3:3] = held
        docs.append((i, "\n ".join(text)))
    return docs + [(None, items[5][1]), (100, None), (101, ""), docs[1], docs[1], (102, "a b " * 40)], items


@pytest.mark.parametrize("copy_rows", [1_000_000, 0])
def test_against_brute_force(spark, monkeypatch, copy_rows):
    monkeypatch.setattr(decontam, "COPY_ROWS", copy_rows)
    docs, items = some_rows(7)
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in found.drop("k1", "k2").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def brute_shorter(docs, items, size=5, similarity=0.8):
    """Pairs of a text and an item with more words, the whole text compared."""
    found = set()
    for i, text in docs:
        for j, item in items:
            ws, it = words(text), words(item)
            if not ws or len(ws) >= len(it):
                continue
            width = min(size, len(it))
            have, want = collections.Counter(grams(ws, width)), collections.Counter(grams(it, width))
            value = sum((want & have).values()) / sum((want | have).values())
            if value >= similarity:
                found.add((i, j, 0, len(it), round(value, 6)))
    return found


@pytest.mark.parametrize("copy_rows,radius", [(1_000_000, decontam.RADIUS), (0, 1)])
def test_texts_shorter_than_an_item(spark, monkeypatch, copy_rows, radius):
    monkeypatch.setattr(decontam, "COPY_ROWS", copy_rows)
    rng = random.Random(5)
    items = [(j, " ".join(rng.choice(["a", "b", "c"]) if j % 2 else f"w{rng.randint(0, 500)}" for _ in range(n))) for j, n in enumerate([59, 59, 30, 30, 9, 14, 5, 3])]
    docs = []
    for j, item in items:
        ws = item.upper().split()
        docs += [(100 * j + cut, "\t".join(ws[cut // 2 : len(ws) - cut + cut // 2])) for cut in range(1, 14)]
        docs += [(100 * j + 50, " ".join(ws[: len(ws) // 2] + ["changed"] + ws[len(ws) // 2 + 3 :])), (100 * j + 51, " ".join(ws[3:]))]
    docs += [docs[0], (None, docs[1][1]), (9000, None), (9001, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leaks(d, b, radius=radius).drop("k1", "k2").collect()]
    want = brute_shorter(docs, items)
    assert (51, 0, 0, 59, round(52 / 55, 6)) in want and len(want) > 20
    longer = brute(docs, items)
    assert len(got) == len(set(got)) and set(got) - longer == want
    if radius == decontam.RADIUS:
        held = {i for i, *_ in want | longer}
        assert set(got) == want | longer
        assert {r.doc_id for r in clean(d, b).collect()} == {i for i, _ in docs} - held


def test_pairs_beyond_the_radius(spark):
    rng = random.Random(11)
    item = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(40):
        text = list(item)
        text[rng.choice([0, 1, 2, 37, 38, 39])] = f"x{i}"
        docs.append((i, " ".join([f"y{i}"] * (i % 5) + text + [f"z{i}"])))
    items = [(1, " ".join(item))]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), radius=1)
    got = [tuple(r) for r in found.drop("k1", "k2").collect()]
    assert len(got) == 40 and set(got) == brute(docs, items)


def test_stage_keeps_clean_rows_and_clashing_columns(spark):
    docs = [(1, "x one two three four five six y", 1), (2, "one two three", 2), (None, None, 3), (2, "ONE two three four five six", 4)]
    items = [(1, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id long, text string, k1 long")
    got = clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {docs[1], docs[2]}
    assert clean(df, spark.createDataFrame([], "item_id long, text string")).count() == 4
    assert clean(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_native_plan(spark):
    docs, items = some_rows(3)
    plan = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_no_python_workers(spark):
    """Workers that read an empty list would keep their memory beside those of the pipeline's other stages."""
    docs = spark.range(3).selectExpr("id AS doc_id", "'one two three four five six seven' AS text")
    items = spark.range(1).selectExpr("id AS item_id", "'one two three four five six seven' AS text")
    found = leaks(docs, items)
    assert found.count() == 3
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
