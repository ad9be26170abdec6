"""Alignment against both tokenizers run on whole texts, and a brute-force count of links."""

import collections
import hashlib
import random

import numpy as np
import pytest

from clausework.llm import token_alignment as A
from clausework.llm.queries import BYTE_LEVEL, VOCABULARY


@pytest.fixture(scope="module")
def files():
    return A.read_tokenizers(BYTE_LEVEL, VOCABULARY)


@pytest.fixture(scope="module")
def aligner(files):
    return A.Aligner(files)


def whole(aligner, text):
    """Ids and bytes of both tokenizers over the whole text; none if they don't give it back."""
    raw = (" " + text).encode()
    a = aligner.one.encode(" " + text, add_special_tokens=False).ids
    b = aligner.two.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], [], [], []
    return a, b, np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()


def brute(aligner, docs):
    """The query's rows from whole encodings, all pairs of overlapping ranges and plain counting."""
    found, linked = [], collections.Counter()
    for i, text in docs:
        a, b, a_ends, b_ends = whole(aligner, text or "")
        ranges = [list(zip([0, *ends], ends)) for ends in (a_ends, b_ends)]
        links = [(a[x], b[y]) for x, p in enumerate(ranges[0]) for y, q in enumerate(ranges[1]) if p[0] < q[1] and q[0] < p[1]]
        linked.update(links)
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, lo = [], 0
        for cut in cuts:
            part = [",".join(str(t) for t, e in zip(ids, ends) if lo < e <= cut) for ids, ends in ((a, a_ends), (b, b_ends))]
            groups.append("|".join(part))
            lo = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((i, len(a), len(b), len(groups), links, sha))
    top = collections.Counter()
    for (_, b), n in linked.items():
        top[b] = max(top[b], n)
    return [
        (i, n_a, n_b, g, len(links), sum(linked[x] == top[x[1]] for x in links), sum(linked[x] for x in links), sha)
        for i, n_a, n_b, g, links, sha in found
    ]


ODD = [" ", " ", "\n", "\n", "\t", "a", "b", "the", "é", "ß", "▁", "中", "\u3000", "\x85", "\xa0", "'s", "'", "1", "23", ".", ",", "<s>"]
ODD += ["<|endoftext|>", "\x1c", "\u180e", "\u200b", "\U0001f600", "\x00", "\r", "A", "Th", "<0x0A>", "\u0301", "<unk>"]


def test_stretches_encode_as_the_whole_text(aligner):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 16)))
        parts = aligner.align(aligner.stretches(text))
        want = whole(aligner, text)
        assert ([], []) == want[:2] if not parts.sound.all() else (parts.a.tolist(), parts.b.tolist()) == want[:2]


def test_groups_are_cut_at_every_common_end():
    rng = random.Random(4)
    for _ in range(300):
        a, b, a_bounds, b_bounds, want, at = [], [], [0], [0], [], 0
        for _ in range(rng.randint(0, 5)):  # intervals one after the other
            n = rng.choice([1, 4, 60])
            own = [[at + i for i in range(1, n) if rng.random() < p] + [at + n] for p in (rng.random(), rng.random())]
            a, b, at = a + own[0], b + own[1], at + n
            a_bounds.append(len(a))
            b_bounds.append(len(b))
        want = [(a.index(c) + 1, b.index(c) + 1) for c in sorted(set(a) & set(b))]
        after = A.shared_groups(*(np.array(x, np.int64) for x in (a, b, a_bounds, b_bounds)))
        assert list(zip(*(x.tolist() for x in after))) == want


@pytest.mark.parametrize("block", [1, 200, 16 << 20])
def test_against_whole_encodings(spark, files, aligner, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    rng = random.Random(block)
    words = ["the", "and", "tokenizer", "alignment", "über", "naïve", "x1y2", "don't", "12345", "中文字", "\n", "  "]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    docs += [(100 + i, "".join(rng.choice(ODD) for _ in range(9))) for i in range(20)]
    docs += [(200, None), (201, ""), (202, "▁ mark"), (None, "the end"), docs[3], docs[3], (203, "nospace" * 300)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, block int").repartition(3)
    got = [tuple(r) for r in A.alignment(table, files).collect()]
    assert sorted(got, key=repr) == sorted(brute(aligner, docs), key=repr)


def test_given_documents(spark, files, aligner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").select("doc_id", "text")
    got = sorted(map(tuple, A.alignment(docs, files).collect()))
    assert got == sorted(brute(aligner, [tuple(r) for r in docs.collect()])) and sum(r[5] for r in got) > 0


def test_groups_give_the_text_back(spark, files, aligner):
    docs = [(1, "align these two tokenizations,\nplease"), (2, None), (3, "▁"), (None, "x")]
    rows = A.aligned_groups(spark.createDataFrame(docs, "doc_id long, text string"), files).collect()
    for i, text in docs:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.group)
        raw = (" " + text).encode() if text and "▁" not in text else b""
        assert b"".join(raw[r.start : r.end] for r in own) == raw and [r.group for r in own] == list(range(len(own)))
        for r in own:
            for ids, table in ((r.a, aligner.a_bytes), (r.b, aligner.b_bytes)):
                assert b"".join(table[t] for t in ids) == raw[r.start : r.end]


def test_empty_table(spark, files):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment(docs, files).collect() == [] and A.aligned_groups(docs, files).collect() == []
