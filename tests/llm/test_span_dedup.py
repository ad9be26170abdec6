"""Removal of repeated strings against brute force, with hot anchors and cut texts."""

import collections
import random

import numpy as np
import pytest

from clausework.llm import span_dedup
from clausework.llm import span_dedup as S
from clausework.llm.span_dedup import remove_repeats, span_digest

NO_ID = -(2**63)


def brute(rows, length, first):
    data = [(t or "").encode() for _, t in rows]
    ids = [NO_ID if i is None else i for i, _ in rows]
    seen = collections.defaultdict(list)
    for r, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].append((ids[r], r, s))
    out = []
    for r, b in enumerate(data):
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            places = seen[b[s : s + length]]
            earlier = min(p[0] for p in places) < ids[r] or any(p[1] == r and p[2] < s for p in places)
            if earlier if first else len(places) > 1:
                covered[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((rows[r][0], len(b), runs, bytes(x for x, c in zip(b, covered) if not c)))
    return sorted(out, key=repr)


def some_rows(length, seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    pool = [noise(rng.randint(20, length * 3)) for _ in range(6)]
    rows = []
    for i in range(50):
        parts = [rng.choice([rng.choice(pool), noise(rng.randint(0, length)), "ab" * rng.randint(0, length), "é" * 7]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, noise(15) + pool[0] + "x" + noise(15)) for i in range(20)]  # one passage in many surroundings
    return rows + [(200, None), (201, ""), (None, rows[3][1]), (202, rows[5][1])]


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("length,gram,group,chunk", [(30, 10, 16_384, 1_000_000), (40, 12, 2, 300), (200, 50, 16_384, 1_000_000)])
def test_against_brute_force(spark, monkeypatch, length, gram, group, chunk, first):
    for name, value in (("GROUP", group), ("CHUNK", chunk), ("BATCH", 2_000)):
        monkeypatch.setattr(span_dedup, name, value)
    rows = some_rows(length, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeats(docs, length, gram, first).collect()]
    assert sorted(got, key=repr) == brute(rows, length, first)


def test_by_shuffle_instead_of_copies(spark, monkeypatch):
    monkeypatch.setattr(span_dedup, "COPY_ROWS", 0)
    rows = some_rows(30, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeats(docs, 30, 10).collect()]
    assert sorted(got, key=repr) == brute(rows, 30, False)


def test_equal_rows_and_empty_table(spark):
    rows = [(1, "x" * 10 + "y" * 300, 5), (1, "x" * 10 + "y" * 300, 5), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    assert sorted((tuple(r)[:4] for r in span_digest(docs).collect()), key=repr) == sorted([(1, 310, 310, 1), (1, 310, 310, 1), (None, 0, 0, 0)], key=repr)
    assert span_digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("depth", [8, 11, 40])
def test_longest_previous_factors_against_brute_force(depth):
    rng = random.Random(depth)
    for _ in range(40):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(depth, 160))) + bytes(rng.choice([b"", b"ababab" * 9])) * 2
        at = np.arange(len(text) - depth + 1)
        place = at.copy()
        rng.shuffle(place)  # the order in the texts is not that of the bytes
        factor, source = S.longest_previous(S.Suffixes(np.frombuffer(text, np.uint8), depth), at, place)
        for i in at:
            shared = {}
            for j in at:
                if place[j] < place[i]:
                    n = 0
                    while n < depth and text[i + n] == text[j + n]:
                        n += 1
                    shared[int(j)] = n
            best = max(shared.values(), default=0)
            assert factor[i] == best
            assert source[i] == -1 if not best else shared[int(source[i])] == best
