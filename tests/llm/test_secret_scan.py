"""Secret scan against plain Python."""

import hashlib
import random
import re

from clausework.llm import secret_scan as scan
from clausework.llm.secret_scan import secret_report

ASSIGN = re.compile("(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)".replace("(?:", "(?i:", 1))
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def every(text, reach):
    strong = base(text)
    order = list(scan.KINDS)
    weak = []
    for kind in ("ident", "key", "endpoint"):
        for m in re.finditer(scan.KINDS[kind], text):
            if kind == "key" and not all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")):
                continue
            if not any(s < m.end() and e > m.start() for s, _, e, _ in strong):
                weak.append((m.start(), order.index(kind), m.end(), kind))
    parts = strong + weak
    near = lambda at, role: any(abs(p[0] - at) <= reach and scan.ROLES.get(p[3]) == role for p in parts)
    needs = {"ident": ["secret"], "key": ["ident"], "endpoint": ["ident", "secret"]}
    return sorted(strong + [w for w in weak if all(near(w[0], r) for r in needs[w[3]])])


def want(i, text, reach=scan.REACH):
    text = text or ""
    said = lambda found: ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    strong = base(text)
    counts = [sum(f[3] == k for f in strong) for k in scan.BASE]
    return (i, *counts, hashlib.sha256(said(strong).encode()).hexdigest(), said(every(text, reach)))


def some_texts(n, seed):
    rng = random.Random(seed)
    run = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    mixed = "abcdefXYZ0123456789+/"
    parts = [
        lambda: f"{rng.choice(['password', 'PassWd', 'api_key', 'apiKey', 'token', 'Secret'])}{rng.choice(['=', ': ', '\" : \"', ' ='])}{run(rng.randint(1, 14), 'abcXYZ019._=-')}",
        lambda: "AKIA" + run(rng.randint(0, 20), "ABCZ019"),
        lambda: run(rng.randint(20, 45), "0123456789abcdef"),
        lambda: f"user={run(5, 'abc')}",
        lambda: f"access_key_id: {run(rng.randint(2, 9), 'abc9')}",
        lambda: run(rng.randint(15, 40), mixed),
        lambda: f"https://host{rng.randint(0, 9)}.example/path",
        lambda: "words and é 😀 more " * rng.randint(0, 12),
        lambda: rng.choice(["\x01", "\x02", "\x01\x02", "\n", "secret: token: abcdefghij"]),
    ]
    return ["".join(rng.choice(parts)() + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_against_plain_python(spark):
    rows = list(enumerate(some_texts(300, 2))) + [(None, None), (1000, ""), (1001, "x " * 60_000 + "user=abc " + "token=abcdefgh12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in secret_report(docs).collect()]
    assert sorted(got, key=repr) == sorted((want(i, t) for i, t in rows), key=repr)


def test_equal_rows_clashing_columns_and_empty_table(spark):
    row = (1, "password=abcdefgh1 user=bob1", "x", 5)
    docs = spark.createDataFrame([row, row, (1, "other", "y", 6)], "doc_id long, text string, kind string, k1 int")
    got = sorted(tuple(r) for r in secret_report(docs).collect())
    assert got == sorted([want(1, row[1]), want(1, row[1]), want(1, "other")])
    assert secret_report(docs.limit(0)).collect() == []


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh1")], "doc_id long, text string")
    plan = secret_report(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
