"""Line dedup against a brute-force version."""

import collections
import hashlib
import random

import pytest

from clausework.llm.line_dedup import drop_lines, line_digest

WHITE = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, chars=20, docs=3):
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(NO_ID if i is None else i)
    out = []
    for i, text in rows:
        own = NO_ID if i is None else i
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= docs and own != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_rows(n, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of the pool of texts" for i in range(30)]
    rows = []
    for i in range(n):
        lines = [
            rng.choice(["a very hot line of text", rng.choice(pool), "short", " \tA Very Hot LINE of text\r", f"only {rng.random()} here and now"])
            for _ in range(rng.randint(0, 8))
        ]
        rows.append((i, "\n".join(lines)))
    extra = [(None, "a very hot line of text"), (None, pool[0]), (4, pool[1] + "\nx"), rows[3], rows[3], (10**12, None), (7, "")]
    return rows + extra


@pytest.mark.parametrize("batch", ["3", "10000"])
@pytest.mark.parametrize("n", [20, 600])
def test_against_brute_force(spark, n, batch):
    rows = some_rows(n, n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = [tuple(r) for r in line_digest(docs).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stage_keeps_other_columns_and_clashing_names(spark):
    rows = [(i, "the same long line of text\nown %d" % i, i, "k", 5) for i in range(4)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 long, keep string, n_dropped int")
    got = drop_lines(docs)
    assert got.schema.names == docs.schema.names
    assert {(r.doc_id, r.text, r.k1, r.keep, r.n_dropped) for r in got.collect()} == {
        (0, "own 0", 0, "k", 5), (1, "own 1", 1, "k", 5), (2, "own 2", 2, "k", 5),
        (3, "the same long line of text\nown 3", 3, "k", 5), (None, None, None, None, None),
    }


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_digest(docs).collect() == []
    assert drop_lines(docs).collect() == []


def test_only_texts_that_lose_lines_go_to_python(spark):
    docs = spark.range(4).selectExpr("id AS doc_id", "concat('the same long line of text\\nown ', id) AS text")
    for rows in (drop_lines(docs), line_digest(docs)):
        nodes = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [n for n in nodes if "MapInArrow" in n and "text" in n]
        assert ["CASE WHEN" in n for n in nodes if "ArrowEvalPython" in n] == [True]
