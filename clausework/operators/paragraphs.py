"""Paragraph tables: explode, filter, deduplicate, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import text as X
from clausework.operators.pages import paragraph_rows


def explode_lines(df: DataFrame, keys: list[str], text: str = "text", distinct: bool = False) -> DataFrame:
    """One row ``(keys, pos, paragraph)`` per line; ``pos`` is the line's number in the text.

    With ``distinct`` a repeated line counts once per row of ``df``, where it stands first.
    """
    lines = F.split(F.col(text), "\n")
    if not distinct:
        return df.select(*keys, F.posexplode(lines).alias("pos", "paragraph"))
    placed = F.transform(lines, lambda line, i: F.struct(X.strip(line).alias("paragraph"), i.alias("pos")))
    ordered = df.select(*keys, F.array_sort(placed).alias("_lines"))
    first = F.filter(
        "_lines", lambda x, i: (i == 0) | (x["paragraph"] != F.element_at("_lines", F.greatest(i, F.lit(1)))["paragraph"])
    )
    # outer, as the planner would otherwise sort the lines once more to see which rows have any
    rows = ordered.select(*keys, F.explode_outer(first).alias("_line"))
    return rows.where("_line IS NOT NULL").select(*keys, "_line.pos", "_line.paragraph")


def explode_terms(df: DataFrame, keys: list[str], reply: str, name: str = "term") -> DataFrame:
    """One row per non-blank line of a model's newline-separated list."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(reply), "\n")).alias("pos", name))
    return rows.where(X.non_blank(F.col(name)))


def strip_paragraphs(df: DataFrame) -> DataFrame:
    return df.withColumn("paragraph", X.strip(F.col("paragraph")))


def non_blank(df: DataFrame) -> DataFrame:
    return df.where(X.non_blank(F.col("paragraph")))


def min_words(df: DataFrame, n: int = X.MIN_WORDS) -> DataFrame:
    """Keep paragraphs of strictly more than ``n`` words."""
    return df.where(X.more_words_than(F.col("paragraph"), n))


# columns that identify a copy, by scope; the first copy in (page, pos) order is kept
_SCOPES = {"page": ("url", "page_key"), "site": ("url",), "global": ()}


def dedupe(df: DataFrame, scope: str = "page") -> DataFrame:
    """One row per paragraph text within ``scope``: ``page``, ``site`` or ``global``.

    Expects ``url, page_key, pos, paragraph``. A grouped minimum by two 64-bit hashes of the text, so texts are carried
    but never compared, copies meet inside the map tasks first, and a text that fills a third of the table leaves each
    task as one row.
    """
    digest = [F.xxhash64("paragraph").alias("_h1"), F.xxhash64(F.lit(1), "paragraph").alias("_h2")]
    row = F.struct("url", "page_key", "pos", "paragraph")
    first = F.min_by(row, F.struct("page_key", "pos", "url")).alias("_first")
    return df.groupBy(*_SCOPES[scope], *digest).agg(first).select("_first.*")


def tidy(df: DataFrame) -> DataFrame:
    """White space clean-up, then quotes: the last two steps of sanitising."""
    return df.withColumn("paragraph", X.sanitise_quotes(X.normalise_ws(F.col("paragraph"))))


def sanitise_pages(pages: DataFrame, site: str = "url", page_key: str = "page_id", n: int = X.MIN_WORDS) -> DataFrame:
    """``url, page_key, pos, paragraph`` of every page: extract, strip, count words, deduplicate per page, tidy.

    Deduplicating before the word filter gives the same rows, so the parse does it and the job has no shuffle.
    White space is cleaned last: two texts that differ only in it both stay.
    """
    source = pages.select(F.col(site).alias("url"), F.col(page_key).alias("page_key"), "html")
    return tidy(min_words(paragraph_rows(source, ["url", "page_key"], distinct=True), n))


def sanitise_lines(docs: DataFrame, site: str, page_key: str, text: str = "text", n: int = X.MIN_WORDS) -> DataFrame:
    """The same on documents whose paragraphs are lines; no shuffle either."""
    source = docs.select(F.col(site).alias("url"), F.col(page_key).alias("page_key"), text)
    return tidy(min_words(non_blank(explode_lines(source, ["url", "page_key"], text, distinct=True)), n))


def concat_splits(splits: list[DataFrame]) -> DataFrame:
    """All split tables as one, with their ``split`` number."""
    numbered = [df.withColumn("split", F.lit(i)) for i, df in enumerate(splits)]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df)
    return out


def dataset_stats(df: DataFrame, site: str = "url") -> DataFrame:
    """``split, rows, sites`` per split. A site in two splits counts in both."""
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct(site).alias("n_sites")
    )


def dataset_totals(df: DataFrame, site: str = "url") -> DataFrame:
    """One row: paragraph total, sites summed over splits, and distinct sites overall."""
    per_pair = df.groupBy("split", site).agg(F.count("*").alias("n"))
    per_site = per_pair.groupBy(site).agg(F.sum("n").alias("n"), F.count("*").alias("splits"))
    return per_site.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("splits"), F.lit(0)).alias("n_sites_summed"),
        F.count("*").alias("n_sites_distinct"),
    )
