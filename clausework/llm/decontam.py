"""Benchmark decontamination: fingerprints of item-sized windows, searched by Hamming blocks, then checked exactly.

Column functions only. A window can resemble an item only if they share word shingles, so windows of an item's size
are laid only where a text holds at least half as many shingles of items of that size; nothing similar enough is lost
by that. A text with fewer words than an item is one window for it, laid where it holds enough of such items' shingles.
Every window gets a 64-bit SimHash of its shingles. The fingerprint is cut into ``radius + 1`` blocks: two
fingerprints within ``radius`` agree in one block at least, so joining on blocks finds every such pair. Pairs within
the radius are then compared exactly, by the shingles' counts; pairs beyond the radius too, where the window holds as
many shingles of such items as a pair similar enough has in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import LOWER, UPPER, WHITE, row_key
from clausework.operators.lineage import materialise

SHINGLE = 5
SIMILARITY = 0.8
# windows of equal size at similarity 0.8 share 0.889 of their shingles: 10 of 64 bits differ, with a deviation of 3
RADIUS = 19
# for the rounding of a share times a count, so that no window is lost to it
SLACK = 1e-6
# item tables up to so many rows are copied to the tasks (tens of bytes each); larger ones are joined by shuffle
COPY_ROWS = 1_000_000

# bits set in more than half of the shingles, counted bit by bit
_SIMHASH = """aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
    2 * aggregate(win, 0, (n, x) -> n + cast(shiftright(x, b) & 1L as int)) > size(win), shiftleft(1L, b), 0L))"""


def _sized(items: DataFrame) -> DataFrame:
    """A side of a join that is copied to the tasks only when its rows have been counted and are few."""
    return F.broadcast(items) if items.count() <= COPY_ROWS else items


def _with_shingles(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``grams``: hashes of the runs of ``width`` words, at the place of their first word."""
    text = F.translate(F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE)), UPPER, LOWER)
    split = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "[\\x20\\x09-\\x0D]+"))
    tokens = rows.withColumn("tokens", split)
    hashed = tokens.withColumn("hashes", F.transform("tokens", lambda w: F.xxhash64(w))).drop("tokens")
    runs = F.transform(
        "hashes", lambda x, i: F.xxhash64(x, *[F.get("hashes", i + j) for j in range(1, width)])
    )
    n = F.size("hashes") - (width - 1)
    return hashed.withColumn("grams", F.when(n > 0, F.slice(runs, 1, n)).otherwise(F.array().cast("array<bigint>")))


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    """``item_id, words, width, grams``: items with words; a short item is one run of all its words."""
    counted = _with_shingles(benchmark.select("item_id", "text"), 1).withColumn("words", F.size("hashes"))
    base = counted.where("words > 0").select("item_id", "text", "words", F.least("words", F.lit(size)).alias("width"))
    widths = [r[0] for r in base.select("width").distinct().collect()]  # at most ``size`` numbers
    parts = [_with_shingles(base.where(F.col("width") == w), w) for w in widths]
    if not parts:
        return base.select("item_id", "words", "width", F.array().cast("array<bigint>").alias("grams"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select("item_id", "words", "width", "grams").distinct()


def _blocks(radius: int):
    """An array of ``(block, value)`` of the fingerprint ``fp``."""
    cuts = [64 * j // (radius + 1) for j in range(radius + 2)]
    values = [
        F.struct(
            F.lit(j).alias("block"),
            F.expr(f"shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L").alias("value"),
        )
        for j, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    return F.array(*values)


def _windows(docs: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    """``k1, k2, doc_id, words, start, exact, win``: windows of an item's size with at least half of such items' shingles.

    A text with fewer words is one window, if it holds ``similarity`` times as many of their shingles as an item has.
    ``exact``: pairs beyond the radius are to be compared too.
    """
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    grams = items.select("words", F.explode("grams").alias("gram")).distinct()
    # outer, as the planner would otherwise hash the texts once more to see which rows have anything to explode
    text_grams = _with_shingles(keyed, width).select(
        "k1", "k2", "doc_id", F.size("hashes").alias("len"), F.posexplode_outer("grams").alias("pos", "gram")
    )
    anchors = materialise(text_grams.join(_sized(grams), "gram").drop("gram"), "anchors").distinct()
    span = F.col("words") - width  # places between the first and the last shingle of a window
    first, last = F.greatest(F.lit(0), F.col("pos") - span), F.least("pos", F.col("len") - F.col("words"))
    shorter = F.col("len") < F.col("words")
    alike = 2 * similarity / (1 + similarity)  # the share of shingles in common at that similarity, for equal sizes
    laid = (
        anchors.withColumn("start", F.explode(F.when(shorter, F.array(F.lit(0))).otherwise(F.sequence(first, last))))
        .groupBy("k1", "k2", "words", "start")
        .agg(F.count("*").alias("shared"), F.max("len").alias("len"))
        .where(F.col("shared") >= F.when(shorter, similarity * (span + 1) - SLACK).otherwise((span + 1) / 2))
        .select("k1", "k2", "words", "start", (shorter | (F.col("shared") >= alike * (span + 1) - SLACK)).alias("exact"))
    )
    laid = materialise(laid, "windows")
    holders = materialise(laid.select("k1", "k2").distinct(), "holders")
    texts = _with_shingles(keyed.join(_sized(holders), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), width)
    cut = F.slice("grams", F.col("start") + 1, F.col("words") - width + 1)
    return laid.join(texts.select("k1", "k2", "doc_id", "grams"), ["k1", "k2"]).select(
        "k1", "k2", "doc_id", "words", "start", "exact", cut.alias("win")
    )


def _similar(windows: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``k1, k2, doc_id, item_id, start, similarity`` of pairs that are similar enough: all within the radius, and those
    of ``exact`` windows beyond it."""
    laid = materialise(windows.withColumn("fp", F.expr(_SIMHASH)), "fingerprints")
    own = items.withColumnRenamed("grams", "win").withColumn("fp", F.expr(_SIMHASH))
    by_block = own.select("item_id", "words", F.col("fp").alias("item_fp"), F.explode(_blocks(radius)).alias("b"))
    keyed = ["k1", "k2", "doc_id", "words", "start"]
    near = (
        laid.select(*keyed, "fp", F.explode(_blocks(radius)).alias("b"))
        .join(_sized(by_block), ["words", "b"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select(*keyed, "item_id")
        .distinct()
    )
    counts = items.select("item_id", F.size("grams").alias("grams"), F.explode("grams").alias("gram"))
    counts = counts.groupBy("item_id", "grams", "gram").agg(F.count("*").alias("item_n"))
    pair = [*keyed, "item_id", "grams", "own"]
    within = (
        near.join(laid.select("k1", "k2", "words", "start", "win"), ["k1", "k2", "words", "start"])
        .select(*keyed, "item_id", F.size("win").alias("own"), F.explode("win").alias("gram"))
        .groupBy(*keyed, "item_id", "own", "gram")
        .agg(F.count("*").alias("win_n"))
        .join(_sized(counts), ["item_id", "gram"])
        .groupBy(*pair)
        .agg(F.sum(F.least("item_n", "win_n")).alias("both"))
    )
    item = ["item_id", "words", "item_fp", "grams"]
    own_counts = own.select("item_id", "words", F.col("fp").alias("item_fp"), F.size("win").alias("grams"), F.explode("win").alias("gram"))
    own_counts = own_counts.groupBy(*item, "gram").agg(F.count("*").alias("item_n"))
    beyond = (
        laid.where("exact")
        .select(*keyed, "fp", F.size("win").alias("own"), F.explode("win").alias("gram"))
        .join(_sized(own_counts), ["words", "gram"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) > radius)
        .groupBy(*pair, "item_fp", "gram", "item_n")
        .agg(F.count("*").alias("win_n"))
        .groupBy(*pair, "item_fp")
        .agg(F.sum(F.least("item_n", "win_n")).alias("both"))
        .drop("item_fp")
    )
    value = F.col("both") / (F.col("own") + F.col("grams") - F.col("both"))  # sum of smaller over sum of larger counts
    return within.unionByName(beyond).withColumn("similarity", value).where(F.col("similarity") >= similarity)


def leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity, k1, k2``: benchmark items that texts hold, at their best window.

    Words lie between ASCII white space, A-Z in lower case. A window has as many words as the item; similarity is the
    weighted Jaccard index of their ``size``-word shingles (an item with fewer words is one shingle). ``start`` is the
    first word of the most similar window, the first of equals. A text with fewer words than an item is one window for it, from
    word 0, and is rated by the same index; ``n_words`` are the item's words. Null and empty texts and items hold nothing; equal rows
    give one result; items that share an id are judged apart and reported once.
    """
    items = materialise(_items(benchmark, size), "items")
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most ``size`` numbers
    schema = {"doc_id": "long", "item_id": "long", "start": "int", "n_words": "int", "similarity": "double", "k1": "long", "k2": "long"}
    # from columns: an empty list of rows would be read by Python workers, which then stay idle beside the others
    found = docs.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in schema.items()])
    for width in sorted(widths):
        own = items.where(F.col("width") == width).drop("width")
        pairs = _similar(_windows(docs, own, width, similarity), own, similarity, radius)
        found = found.unionByName(
            pairs.select(
                F.col("doc_id").cast("long"), F.col("item_id").cast("long"), "start", F.col("words").alias("n_words"),
                F.round("similarity", 6).alias("similarity"), "k1", "k2",
            )
        )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")
    return found.groupBy("k1", "k2", "doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", "best.similarity", "k1", "k2"
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; see ``leaks``."""
    held = leaks(docs, benchmark, **settings).select("k1", "k2").distinct()
    keyed = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))
    return keyed.join(held, ["k1", "k2"], "left_anti").select("row.*")
