"""Near dedup against brute force, and the sketch's properties."""

import random

import numpy as np
import pytest

from clausework.llm import near_dedup
from clausework.llm.common import WordHashes, ascii_words, shingle_set
from clausework.llm.near_dedup import BINS, near_duplicates, one_of_each, sketch


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset((width, *words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, s in sets if i is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    held = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(held):
        for j, b in held[:x]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return [
        (i, len(s), None if i is None else find(i) if s else i, i is None or (find(i) if s else i) == i) for i, s in sets
    ]


def some_rows(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, words))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i * 3, " ".join(text)))
    rows += [(1, ""), (2, None), (4, " \t\n"), (5, "one"), (7, "ONE"), (8, "one two"), (None, rows[0][1]), rows[5], (3, rows[9][1])]
    return rows


@pytest.mark.parametrize("block", [512, 7])
@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, monkeypatch, block, size, percent):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rows = some_rows(150, size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in near_duplicates(docs, size, percent).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, size, percent), key=repr)


def test_by_shuffle_instead_of_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COPY_ROWS", 0)
    rows = some_rows(40, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_duplicates(docs, 3, 85).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 3, 85), key=repr)


def test_stage_keeps_one_and_all_columns(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "another text of its own words", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    assert {tuple(r) for r in one_of_each(docs).collect()} == {rows[1], rows[2], rows[3]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []


def test_sketch_agreement_concentrates_around_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 127, 128, 900):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        assert len(sketch(np.unique(a))) == BINS
        assert (sketch(np.unique(a)) == sketch(np.unique(a))).all()
    for n in (100, 140, 1000):  # the two ways of making a sketch meet at 128 shingles
        agreed = []
        for _ in range(20):
            common = rng.integers(1, 2**63, int(n * 0.8)).astype(np.uint64)
            a, b = (np.unique(np.r_[common, rng.integers(1, 2**63, int(n * 0.1)).astype(np.uint64)]) for _ in range(2))
            agreed.append((sketch(a) == sketch(b)).mean())
        assert abs(np.mean(agreed) - 0.8) < 0.04


def test_shingles_of_short_texts():
    hashes = WordHashes()
    of = lambda text: shingle_set(hashes.of(ascii_words(text)), 3)
    assert len(of(b"")) == 0 and len(of(b"a")) == 1 and len(of(b"a b")) == 1 and len(of(b"a b c a b c")) == 3
    assert (of("É a".encode()) != of("é a".encode())).any()  # only A-Z change
