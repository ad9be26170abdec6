"""URL rules against plain Python, and the propagated trust against a dense power iteration."""

import random
import re

import numpy as np
import pytest

from clausework.llm import url_filter as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match("[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def hrefs(html):
    tags = re.split(r"(?i)<a(?=\s)", html or "")[1:]
    found = (re.search(r"""(?i)(?:^|\s)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s]+)""", t.split(">")[0]) for t in tags)
    return {m[1].lower() for m in found if m}


def scores(n, links, seeds, rounds=400):
    """Dense personalised PageRank whose dangling hosts jump back to the seeds."""
    start = seeds / seeds.sum()
    rank = start.copy()
    out = links.sum(axis=1)
    for _ in range(rounds):
        flow = np.where(out[:, None] > 0, links / np.maximum(out, 1)[:, None], start[None, :])
        rank = (1 - U.DAMPING) * start + U.DAMPING * (rank @ flow)
    return rank


def brute(pages, rules):
    named = [host_path(u) for _, u, _ in pages]
    fits = [rule_of(*x, rules) for x in named]
    hosts = sorted({h for h, _ in named} | {h for _, _, html in pages for h in hrefs(html)})
    at = {h: i for i, h in enumerate(hosts)}
    links = np.zeros((len(hosts), len(hosts)))
    seeds = {v: np.zeros(len(hosts)) for v in ("allow", "block")}
    for (host, _), (_, verdict), (_, _, html) in zip(named, fits, pages):
        for other in hrefs(html):
            if host and other != host:
                links[at[host], at[other]] += 1
        if verdict:
            seeds[verdict][at[host]] += 1
    zero = np.zeros(len(hosts))
    trust = scores(len(hosts), links, seeds["allow"]) if seeds["allow"].any() else zero
    distrust = scores(len(hosts), links.T, seeds["block"]) if seeds["block"].any() else zero
    out = []
    for (i, _, _), (host, path), (rule, verdict) in zip(pages, named, fits):
        out.append((i, host, path, rule, verdict or ("block" if distrust[at[host]] > trust[at[host]] + 1e-5 else "allow")))
    return out


def some_pages(seed, n=160):
    rng = random.Random(seed)
    hosts = ["a.org", "B.example.org", "example.org", "x.com", "w.x.com", "y.com", "spam.net", "farm.net", "hub.net", "io"]
    rows = []
    for i in range(n):
        path = rng.choice(["", "/", "/en/12", "/es/x?q=/fr/", "/fr/a", "/de/b#c", "/other", "?a=1"])
        # blocked hosts are linked to by the farm, trusted ones link on
        near = hosts[6:] if i % 3 else hosts
        tags = [f'<A class=x HREF = "{rng.choice(["http://", "https://", "//"])}{rng.choice(near)}/p">t</a>' for _ in range(rng.randint(0, 3))]
        tags += rng.choice([[], ['<a href="/local">'], ["<a href='mailto:x'><area href='//no.net'>"], ["<a data-href='//no.net'>"], ["<a href=//cut.net"]])
        rows.append((i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{path}", "".join(tags)))
    rows += [(None, None, None), (500, "no scheme", "<a href='//a.org'>"), (501, "x://y://Z.org/es/", ""), rows[0], rows[0], (502, "", "<a " * 2000)]
    return rows


@pytest.mark.parametrize("seed,per_task", [(1, 100_000), (2, 2)])
def test_against_brute_force(spark, monkeypatch, seed, per_task):
    monkeypatch.setattr(U, "LINKS_PER_TASK", per_task)
    rows = some_pages(seed)
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, part int")
    got = [tuple(r) for r in U.judged(pages.repartition(5)).collect()]
    want = brute(rows, U.RULES)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {v for *_, rule, v in got if rule is None} == {"allow", "block"}


def test_scores_add_up_and_walk_the_right_way(spark):
    links = spark.createDataFrame([("t", "a", 2), ("a", "b", 1), ("s", "d", 1), ("c", "d", 3)], "src string, dst string, weight long")
    seeds = spark.createDataFrame([("trust", "t", 1), ("distrust", "d", 5)], "kind string, host string, weight long")
    found = {(r.kind, r.host): r.score for r in U.propagated(links, seeds).collect()}
    assert set(found) == {("trust", "t"), ("trust", "a"), ("trust", "b"), ("distrust", "d"), ("distrust", "s"), ("distrust", "c")}
    for kind in ("trust", "distrust"):
        assert abs(sum(v for (k, _), v in found.items() if k == kind) - 1) < 1e-9
    assert found["trust", "a"] > found["trust", "b"] and found["distrust", "c"] > found["distrust", "s"]


def test_rules_of_equal_length_and_empty_table(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    rules = (("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", "/"))
    pages = spark.createDataFrame([(1, "http://a.b/xy", None), (2, "http://a.b/", None), (3, "http://ab/", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judged(pages, rules).collect()}
    assert got == {1: ("a.b/x", "block"), 2: ("b/", "allow"), 3: (None, "allow")}
