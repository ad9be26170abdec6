"""Site funnel: reachability, language and class gates, and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions import language
from clausework.functions.responses import parse_site_class


def is_accessible(html: str = "html") -> Column:
    return F.col(html).isNotNull() & (F.col(html) != "")


def accessible(df: DataFrame, html: str = "html") -> DataFrame:
    """Sites whose page was captured and is not empty."""
    return df.where(is_accessible(html))


def html_content_only(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Policy pages served as HTML; every row when the capture has no such column."""
    if content_type not in df.columns:
        return df
    return df.where(F.lower(F.col(content_type)).contains("text/html"))


def english_only(df: DataFrame, lang: str = "language") -> DataFrame:
    return df.where(language.is_english(F.col(lang)))


def shopping_gate(df: DataFrame, mode: str = "strict", column: str = "is_shopping") -> DataFrame:
    """``strict`` keeps class 1; ``truthy`` keeps everything but 0, so unread replies (-1) pass."""
    if mode not in ("strict", "truthy"):
        raise ValueError(f"unknown mode {mode}")
    return df.where(F.col(column) == 1 if mode == "strict" else F.col(column) != 0)


def classify_sites(df: DataFrame, reply: str = "response") -> DataFrame:
    """Add ``is_shopping`` and ``class_error`` from the reply text."""
    value, error = parse_site_class(F.col(reply))
    return df.withColumns({"is_shopping": value, "class_error": error})


def project_sites(df: DataFrame) -> DataFrame:
    """The site record. Every English site whose reply could be read or guessed is kept, whatever its class."""
    return df.select("url", "language", "is_shopping", "html")


def funnel_counts(df: DataFrame, by: str | None = "chunk") -> DataFrame:
    """``accessible, english, is_shopping, error_urls`` per chunk.

    Expects one row per input with ``accessible, english`` (booleans), ``is_shopping``, ``class_error`` and ``url``.
    A chunk holds a fixed number of inputs, so its error list is bounded. Without ``by`` there is one row and
    the errors are only counted.
    """
    is_error = ~F.col("accessible") | (F.col("english") & F.coalesce(F.col("class_error"), F.lit(False)))
    counters = [
        F.count_if("accessible").alias("accessible"),
        F.count_if("english").alias("english"),
        F.count_if(F.col("english") & (F.col("is_shopping") == 1)).alias("is_shopping"),
        F.count_if(is_error).alias("errors"),
    ]
    if by is None:
        return df.agg(*counters)
    errors = F.array_sort(F.collect_list(F.when(is_error, F.col("url")))).alias("error_urls")
    return df.groupBy(by).agg(*counters, errors)


def funnel_totals(counts: DataFrame) -> DataFrame:
    """Sum of the chunk counters, error lists left out."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("accessible", "english", "is_shopping")])


def language_histogram(df: DataFrame, lang: str = "language") -> DataFrame:
    """``language, n``; a missing language is counted under null."""
    return df.groupBy(F.col(lang).alias("language")).agg(F.count("*").alias("n"))


def range_bounds(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Smallest start and largest end."""
    return df.agg(F.min(start).alias("start"), F.max(end).alias("end"))


def file_range(df: DataFrame, start: int, end: int, first: str = "start", last: str = "end") -> DataFrame:
    """Chunk files that lie inside ``start`` to ``end``."""
    return df.where((F.col(first) >= start) & (F.col(last) <= end))


def policy_page_counts(df: DataFrame, site: str = "site") -> DataFrame:
    """One row: sites that have policy pages, and pages."""
    per_site = df.groupBy(site).agg(F.count("*").alias("n"))
    return per_site.agg(F.count("*").alias("n_sites"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pages"))
