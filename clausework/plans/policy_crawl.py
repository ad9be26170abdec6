"""Depth-limited walk over captured pages, one join round per level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.urls import strip_scheme
from clausework.operators.lineage import materialise
from clausework.operators.links import candidate_links, fetch_join, not_visited
from clausework.operators.pages import language_of, parse_pages
from clausework.operators.sites import accessible, english_only, html_content_only, shopping_gate
from clausework.operators.skew import skew_join


def page_facts(pages: DataFrame, link: str = "url", wanted: DataFrame | None = None) -> DataFrame:
    """``link, language, links`` of captured pages, parsed once and written as a table.

    The crawl rounds read this narrow table and never the page text. With ``wanted``, a table of ``link``, only those pages
    reach the parser: they are picked before it, by a copied table where the links are few and else by a filter of their
    hashes and a join.
    """
    source = html_content_only(pages).select(F.col(link).alias("link"), "html").where(F.col("html") != "")
    if wanted is not None:
        source = source.join(wanted.select("link").distinct(), "link", "left_semi")
    parsed = parse_pages(source, ["link"], ("declared_language", "undeclared_text", "links"))
    return materialise(parsed.select("link", language_of().alias("language"), "links"), "page-facts")


def facts_on_demand(pages: DataFrame, link: str = "url") -> Callable[[DataFrame], DataFrame]:
    """Facts for ``crawl_levels``: of each link the page is parsed when a level first asks for it, and not again."""
    return lambda wanted: page_facts(pages, link, wanted)


def site_seeds(sites: DataFrame, mode: str = "strict") -> DataFrame:
    """``seed, links`` of site records that pass the shopping gate: the URL without scheme and its home page's links."""
    gated = shopping_gate(accessible(sites), mode).select(strip_scheme(F.col("url")).alias("seed"), "html")
    return parse_pages(gated, ["seed"], ("links",)).select("seed", "links")


def crawl_levels(seeds: DataFrame, facts: DataFrame | Callable[[DataFrame], DataFrame], max_depth: int = 3) -> DataFrame:
    """Every link looked at: ``seed, link, depth, fetched, english``.

    ``seeds`` has ``seed`` and the ``links`` of its home page; ``facts`` has unique ``link``, ``language``, ``links``, or
    gives such a table for a table of distinct links. Level ``d`` is built from the English pages kept at ``d - 1``. Failed
    and non-English links count as visited. Each level is a table: later rounds read it twice and must not compute it again.
    """
    known = None if callable(facts) else facts
    levels: list[DataFrame] = []
    frontier = candidate_links(seeds)
    for depth in range(1, max_depth + 1):
        if levels:
            kept = levels[-1]
            visited = reduce(DataFrame.unionByName, levels)  # levels are distinct and do not overlap
            english = english_only(known).select("link", "links")
            frontier = not_visited(candidate_links(fetch_join(kept, english)), visited)
        level = materialise(frontier, f"crawl-level-{depth}")
        levels.append(level)
        if level.isEmpty():
            break
        if callable(facts):
            asked = level.select("link").distinct()
            if len(levels) > 1:  # another seed may have asked before
                before = reduce(DataFrame.unionByName, levels[:-1]).select("link").distinct()
                asked = asked.join(before, "link", "left_anti")
            got = facts(asked)
            known = got if known is None else known.unionByName(got)
    walked = reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels, 1)])
    if known is None:  # nothing was ever asked for
        return walked.select("seed", "link", "depth", F.lit(False).alias("fetched"), F.lit(False).alias("english"))
    flags = known.select("link", "language", F.lit(True).alias("fetched"))
    seen = skew_join(walked, flags, ["link"], "left")
    return seen.select(
        "seed",
        "link",
        "depth",
        F.coalesce("fetched", F.lit(False)).alias("fetched"),
        F.coalesce(F.lower("language").startswith("en"), F.lit(False)).alias("english"),
    )


def policy_crawl(seeds: DataFrame, facts: DataFrame | Callable[[DataFrame], DataFrame], max_depth: int = 3) -> DataFrame:
    """Policy pages ``seed, link, depth``: links kept because their page was fetched and is English."""
    return crawl_levels(seeds, facts, max_depth).where("fetched AND english").select("seed", "link", "depth")


def attach_html(policy: DataFrame, pages: DataFrame, link: str = "url") -> DataFrame:
    """``seed, link, depth, html``: the page text joins the kept links only."""
    return fetch_join(policy, pages.select(F.col(link).alias("link"), "html"))
