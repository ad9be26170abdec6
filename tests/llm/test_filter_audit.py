"""The audit against a brute-force version that runs every order, and the transducer against plain Python."""

import collections
import itertools
import random

import pytest

from clausework.llm import filter_audit as A


def plain(text):
    words = text.split()  # bytes: ASCII white space
    return [
        len(words),
        len(set(words)),
        sum(65 <= c <= 90 for c in text),
        sum(c & 0xC0 != 0x80 for c in text),
        sum(c in A.SYMBOLS.encode() for c in text),
    ]


@pytest.mark.parametrize("stretch", [5, 64, 1 << 22])
def test_counts_against_plain_python(monkeypatch, stretch):
    monkeypatch.setattr(A, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(60):
        texts = [bytes(rng.choice(b"aaB #\n\xc3\xa9x|\x0b") for _ in range(rng.choice([0, 1, 6, 50, 600]))) for _ in range(rng.randint(0, 6))]
        texts += [b"w" * 300 + b" " + b"w" * 300 + b" " + b"w" * 301, b"", " é e\u2003x \U0001f600".encode()]
        assert A.count_texts(texts).T.tolist() == list(map(plain, texts))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(A.SpanTable, "_hash", lambda self, start, length, doc: doc * 0 + 7)
    texts = [b"one two three one two six", b"", b"one one", b"a" * 400 + b" " + b"a" * 399 + b"b " + b"a" * 400]
    assert A.count_texts(texts)[1].tolist() == [4, 0, 1, 2]


def brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(i, text):
        text = text or ""
        words, distinct, capitals, points, symbols = plain(text.encode())
        own = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": symbols > 0}
        return {f for f, v in own.items() if v} | ({"E"} if i is not None and first[text] < i else set())

    parts = collections.defaultdict(list)
    for i, text, part in docs:
        parts[part or ""].append((fails(i, text), i in good, i in toxic))
    out = {}
    by_order = collections.Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                alone = sum(r[0] == {f} for r in rows)
                by_order[part, f] += len(here)
                out[part, order, step] = (len(left), len(here), failing - len(here), alone, sum(r[1] for r in here), sum(r[2] for r in here))
    return {k: (*v, by_order[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_every_order(spark):
    rng = random.Random(5)
    pool = ["", None, "Some WORDS here", "plain " * 250, " ".join(f"w{i}" for i in range(220)), "a # b", "UP " * 230]
    pool += [" ".join(f"W{i}" for i in range(210)) + " $"]
    docs = [(i, rng.choice(pool), rng.choice(["x", "y", None, ""])) for i in range(120)]
    docs += [docs[3], docs[3], (None, "Some WORDS here", "x"), (None, "", "only"), (7, "another text of a known id", "y")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, mask int, digest string")
    marks = spark.createDataFrame([(*m, "q") for m in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in A.filter_audit(table.repartition(4), marks).collect()}
    assert got == brute(docs, labels) and len(got) == 600 * 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = A.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r.shapley for r in rows} == {0, 120} and {r.part for r in rows} == {""}
