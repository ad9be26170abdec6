"""Rule tags per paragraph, terms not disclosed, and site profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import taxonomy
from clausework.functions.text import collapse
from clausework.operators.skew import skew_join

Rules = tuple[tuple[str, str], ...]


def rules_from(table: DataFrame) -> Rules:
    """Rules of a ``(category, pattern)`` table: one row per category and pattern, as a user writes them."""
    rows = table.select("category", "pattern").distinct().orderBy("category", "pattern").collect()
    return tuple((r["category"], r["pattern"]) for r in rows)


def taxonomy_tag(df: DataFrame, rules: Rules = taxonomy.UNFAVOURABLE_RULES, text: str = "paragraph") -> DataFrame:
    """Add ``categories``: a rule baseline, not a model's answer."""
    return df.withColumn("categories", taxonomy.tag(F.col(text), rules))


def undisclosed_terms(terms: DataFrame, product_info: DataFrame, site: str = "site", term: str = "term") -> DataFrame:
    """Terms that the site's product information does not state, compared in lower case with single spaces."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_term", F.lower(collapse(F.col(term))))

    stated = keyed(product_info).select(site, "_term").distinct()
    return skew_join(keyed(terms), stated, [site, "_term"], "left_anti").drop("_term")


def site_profile(tagged: DataFrame, categories: list[str], site: str = "url") -> DataFrame:
    """One row per site: paragraphs, tagged paragraphs, distinct categories, and a count column per category.

    One grouped sum over flags: no explode, no pivot shuffle, and a site of any size is pre-summed in the map tasks.
    """
    per_category = [
        F.count_if(F.array_contains("categories", c)).alias(f"n_{i}") for i, c in enumerate(categories)
    ]
    totals = tagged.groupBy(F.col(site).alias("url")).agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if(~F.array_contains("categories", taxonomy.OTHERS)).alias("n_tagged"),
        *per_category,
    )
    counts = [F.col(f"n_{i}") for i in range(len(categories))]
    distinct = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0)).cast("int")
    return totals.select(
        "url",
        "n_paragraphs",
        "n_tagged",
        distinct.alias("n_categories"),
        *[c.alias(name) for c, name in zip(counts, categories)],
    )
