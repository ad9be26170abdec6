"""Embedding, clustering per chunk, and labelling of the clusters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import prompts, taxonomy
from clausework.operators import clustering as C
from clausework.operators import labels as L
from clausework.operators.embedding import Encoder, embed
from clausework.operators.lineage import materialise, settle
from clausework.operators.positions import assign_chunks, assign_splits

# rows of a stage file whose texts are encoded by one task
ENCODED_ROWS = 50_000


def cluster_chunks(
    paragraphs: DataFrame,
    encoder: Encoder,
    eps_list: list[float],
    order: list[str],
    num_chunks: int = 10,
    min_samples: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Placed paragraphs (``pos``, ``chunk``) and their labels ``(chunk, eps, id, cluster_id)`` with ``id = pos``.

    Pairs are only compared inside a chunk, so the work is rows times chunk size.
    """
    placed = assign_chunks(paragraphs, order, num_chunks)
    points = embed(placed.select("chunk", "pos", "paragraph"), encoder).select("chunk", F.col("pos").alias("id"), "vec")
    return placed, C.dbscan_sweep(points, eps_list, min_samples, ["chunk"])


class Splits(NamedTuple):
    """``lines``: ``row, url, page_key, line, paragraph``, the one table with texts; ``places``: ``row, split, chunk, id``; ``labels``:
    ``split, chunk, eps, id, cluster_id``.
    """

    lines: DataFrame
    places: DataFrame
    labels: DataFrame

    def texts(self, rows: DataFrame) -> DataFrame:
        """``rows``, which name ``split, chunk, id``, with the other columns of their lines. Texts are moved once."""
        return rows.join(self.places, ["split", "chunk", "id"]).join(self.lines, "row").drop("row")


def label_splits(
    paragraphs: DataFrame,
    encoder: Encoder,
    eps_list: list[float],
    num_chunks: int = 10,
    min_samples: int = 5,
    sites_per_split: int = 2100,
) -> Splits:
    """Sanitised paragraphs, their places, and the labels of all.

    ``paragraphs`` has ``url, page_key, pos, paragraph``. Sites are dealt to splits, and the paragraphs of a split, in the
    order of site, page and place, to chunks; ``id`` is the paragraph's position in its split. Chunks are compared on
    their own, so the work is rows times chunk size. Texts stay in one table: places are found on the other columns,
    vectors meet their places by row number, and what the steps write on their way is deleted.
    """
    numbered = paragraphs.withColumnRenamed("pos", "line").withColumn("row", F.monotonically_increasing_id())
    lines = materialise(numbered, "paragraphs", ENCODED_ROWS)
    order = ["url", "page_key", "line", "row"]

    def places() -> DataFrame:
        split = assign_splits(lines.select(*order), "url", sites_per_split)
        placed = assign_chunks(split, order, num_chunks, within=["split"])
        return placed.select("row", "split", "chunk", F.col("pos").alias("id"))

    placed = settle(places, "placed")
    vectors = embed(lines.select("row", "paragraph"), encoder).select("row", "vec")
    points = placed.join(vectors, "row").select("split", "chunk", "id", "vec")
    labels = settle(lambda: C.dbscan_sweep(points, eps_list, min_samples, ["split", "chunk"]), "labels")
    return Splits(lines, placed, labels)


def cluster_splits(
    paragraphs: DataFrame,
    encoder: Encoder,
    eps_list: list[float],
    num_chunks: int = 10,
    min_samples: int = 5,
    sites_per_split: int = 2100,
) -> tuple[DataFrame, DataFrame]:
    """Sanitised paragraphs, placed, and their labels ``(split, chunk, eps, id, cluster_id)``; see ``label_splits``.

    The placed table keeps ``url, page_key, line``.
    """
    splits = label_splits(paragraphs, encoder, eps_list, num_chunks, min_samples, sites_per_split)
    return splits.places.join(splits.lines, "row").drop("row"), splits.labels


def bounded_clusters(
    members: DataFrame, keys: list[str], lo: int = 2, hi: int = 1000, include_noise: bool = False, reference_sizes: bool = False
) -> DataFrame:
    """Collected clusters with ``lo < size < hi``. ``members`` has keys, ``cluster_id``, ``id``, ``paragraph``."""
    sizes = C.cluster_sizes(members, keys, include_noise, reference_sizes)
    return C.collect_clusters(members, C.cluster_size_between(sizes, lo, hi), keys)


def financial_prompts(clusters: DataFrame, template: str = prompts.FINANCIAL, k: int = 20, seed: int = 0) -> DataFrame:
    sample = prompts.join_members(L.sample_texts(k, seed))
    return clusters.withColumn("prompt", prompts.build_prompt(template, sample)).withColumn(
        "prompt_hash", prompts.prompt_hash(F.col("prompt"))
    )


def topic_prompts(
    clusters: DataFrame,
    template: str = prompts.CATEGORY,
    categories: tuple[str, ...] = taxonomy.UNFAVOURABLE,
    k: int = 20,
    seed: int = 0,
) -> DataFrame:
    sample = prompts.join_members(L.sample_texts(k, seed))
    prompt = prompts.build_prompt(template, taxonomy=taxonomy.outline(categories), document_list=sample)
    return clusters.withColumn("prompt", prompt).withColumn("prompt_hash", prompts.prompt_hash(F.col("prompt")))


def label_clusters(clusters: DataFrame, responses: DataFrame, key: list[str], unwrap: bool = False) -> DataFrame:
    """Every cluster with its financial class; filter with ``financial_filter``, look at ``rejects``.

    ``key`` includes the chunk, so clusters of different chunks never share a reply.
    """
    return L.financial_labels(L.response_join(clusters, responses, key), unwrap)


def topic_clusters(filtered: DataFrame, responses: DataFrame, key: list[str], unwrap: bool = False) -> DataFrame:
    """Clusters with an unfavourable category."""
    plain = filtered.drop("response", "classification", "confidence")
    return L.not_benign(L.category_labels(L.response_join(plain, responses, key), unwrap))
