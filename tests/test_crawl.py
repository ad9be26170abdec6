"""The walk against a plain breadth-first search on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from clausework.operators import skew
from clausework.plans import policy_crawl as CR
from tests.test_urls import spec_match


def spec_walk(home_links, seed, pages, depth):
    """Level by level: fetch unseen links, keep English pages, follow their links."""
    good = lambda links: [x for x in links if spec_match(x, seed)]
    pending, seen, kept = good(home_links), set(), {}
    for level in range(1, depth + 1):
        found = set()
        for link in pending:
            if link in seen:
                continue
            seen.add(link)
            language, links = pages.get(link, (None, []))
            if language and language.lower().startswith("en"):
                kept[link] = level
                found.update(x for x in good(links) if x not in seen)
        pending = found
    return kept


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, monkeypatch, seed):
    salted = []
    if seed:
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 3)
        hot = skew._hot
        monkeypatch.setattr(skew, "_hot", lambda *a: salted.append(hot(*a)) or salted[-1])
    rng = random.Random(seed)
    names = [f"https://h{i % 5}.com/{kind}/{i}" for i in range(60) for kind in ("terms", "privacy", "warranty")]
    pages = {
        n: (rng.choice(["en", "EN-us", "fr", "", None]), rng.sample(names, 4) + [names[0]]) for n in names if rng.random() < 0.8
    }
    seeds = {f"h{i}.com": rng.sample(names, 5) for i in range(5)}
    as_links = lambda links: [(x, None) for x in links]
    schema = "links array<struct<href string, onclick string>>"
    seed_df = spark.createDataFrame([(s, as_links(ls)) for s, ls in seeds.items()], f"seed string, {schema}")
    facts = spark.createDataFrame([(n, la, as_links(ls)) for n, (la, ls) in pages.items()], f"link string, language string, {schema}")
    for depth in (1, 3):
        got = {(r["seed"], r["link"]): r["depth"] for r in CR.policy_crawl(seed_df, facts, depth).collect()}
        expected = {(s, x): d for s, ls in seeds.items() for x, d in spec_walk(ls, s, pages, depth).items()}
        assert got == expected
    assert {d for d in got.values()} == {1, 2, 3}
    assert not seed or any(salted)  # some join split a key


def test_from_html(spark):
    """Home page, terms page, an unreachable link, a French page whose links are not followed, and a cycle."""
    pages = [
        ("https://a.com/terms", "<html lang='en'><a href='/returns'>r</a><a href='https://a.com/terms'>t</a>", "text/html"),
        ("https://a.com/returns", "<html lang='fr'><a href='/warranty'>w</a>", "text/html"),
        ("https://a.com/warranty", "<html lang='en'>", "text/html"),
        ("https://a.com/refund", "<html lang='en'>", "application/pdf"),
        ("https://a.com/shipping-policy", "<html><p>the terms of this and that are for you</p>", "Text/HTML"),
    ]
    df = spark.createDataFrame(pages, "url string, html string, content_type string")
    home = [("/terms", None), ("/refund", None), ("/gone/terms", None), ("/privacy", None), ("javascript:void(0);", "go('https://a.com/shipping-policy')")]
    seeds = spark.createDataFrame([("a.com", home)], "seed string, links array<struct<href string, onclick string>>")
    kept = CR.policy_crawl(seeds, CR.page_facts(df))
    got = sorted((r["link"], r["depth"], r["html"][:6]) for r in CR.attach_html(kept, df).collect())
    assert got == [("https://a.com/shipping-policy", 1, "<html>"), ("https://a.com/terms", 1, "<html ")]
    levels = CR.crawl_levels(seeds, CR.page_facts(df))
    assert levels.where("depth = 1").count() == 4 and levels.where("depth = 2 AND fetched AND NOT english").count() == 1


def test_no_seeds(spark):
    empty = spark.createDataFrame([], "seed string, links array<struct<href string, onclick string>>")
    facts = spark.createDataFrame([], "link string, language string, links array<struct<href string, onclick string>>")
    assert CR.policy_crawl(empty, facts).count() == 0
    assert CR.crawl_levels(empty, facts).agg(F.count("*")).first()[0] == 0
