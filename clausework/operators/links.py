"""Links and the fetch, visited and frontier joins of the crawl."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import urls
from clausework.operators.skew import skew_join


def candidate_links(pages: DataFrame, seed: str = "seed", links: str = "links") -> DataFrame:
    """Distinct ``(seed, link)`` policy links of pages that carry their seed and hyperlinks.

    Resolving and matching depend on the seed. They come before the explode, so only matches reach the one shuffle,
    and repeats are collapsed in the page and in the map tasks first.
    """
    named = pages.select(F.col(seed).alias("seed"), F.col(links).alias("links"))
    found = F.explode(urls.policy_links(F.col("links"), F.col("seed"))).alias("link")
    return named.select("seed", found).distinct()


def fetch_join(links: DataFrame, pages: DataFrame, on: str = "link") -> DataFrame:
    """Links that have a captured page; the others vanish. A link that many seeds share is split."""
    return skew_join(links, pages, [on])


def fetch_errors(links: DataFrame, pages: DataFrame, on: str = "link") -> DataFrame:
    """Links without a captured page."""
    return skew_join(links, pages.select(on), [on], "left_anti")


def not_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier rows ``(seed, link)`` not seen before."""
    return frontier.join(visited, ["seed", "link"], "left_anti")


def not_collected(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return skew_join(df, done.select(*key).distinct(), key, "left_anti")


def union_links(levels: list[DataFrame]) -> DataFrame:
    """Distinct rows of all levels."""
    return reduce(DataFrame.unionByName, levels).distinct()
