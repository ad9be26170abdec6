"""Audit of how text filters interact: what each removes, repeats or alone catches, in every order they could run in.

A table-driven transducer reads the UTF-8 bytes of a batch once. Its outputs count words, capitals, code points and
symbols, and every word span goes into a hash table that takes two spans for one word only if their bytes are equal.
What follows needs a few numbers per document: which filters it fails is a bit mask, and the counts of the masks of a
part give every order's figures, so no document is looked at once per order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import WHITE, payloads
from clausework.operators.lineage import materialise

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
# The characters that condition D looks for.
SYMBOLS = "#$%&*|"

# bytes that are read at a time; a longer text is read in stretches of this size
STRETCH = 1 << 22
# words up to this many bytes are hashed and compared eight bytes at a time, all words at once
SHORT = 256

# The transducer: bytes fall into classes, a class and a state give the next state and what to count.
_GAP, _WORD = 0, 1
_WHITE, _CAPITAL, _SYMBOL, _PLAIN, _LEAD, _REST = range(6)
_BEGINS, _IS_CAPITAL, _IS_POINT, _IS_SYMBOL = 1, 2, 4, 8


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes = np.full(256, _PLAIN, np.uint8)
    classes[0x80:0xC0], classes[0xC0:] = _REST, _LEAD
    classes[ord("A") : ord("Z") + 1] = _CAPITAL
    classes[list(SYMBOLS.encode())] = _SYMBOL
    classes[list(WHITE.encode())] = _WHITE
    follows = np.full((2, 6), _WORD, np.uint8)
    follows[:, _WHITE] = _GAP
    emits = np.full((2, 6), _IS_POINT, np.uint8)
    emits[:, _REST] = 0  # the code point was counted at its first byte
    emits[:, _CAPITAL] |= _IS_CAPITAL
    emits[:, _SYMBOL] |= _IS_SYMBOL
    emits[_GAP, np.arange(6) != _WHITE] |= _BEGINS
    return classes, follows, emits


CLASSES, FOLLOWS, EMITS = _tables()
# A class leads to one state from every state, so the state before a byte is known from the byte before it and a whole
# stretch can be looked up at once.
if not (FOLLOWS == FOLLOWS[0]).all():
    raise AssertionError("the transducer must be in one state after a byte, whatever it was in before")

_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class SpanTable:
    """The distinct words of each document: open addressing with linear probing; equal hashes are checked byte by byte."""

    def __init__(self, data: np.ndarray):
        """``data`` has eight spare bytes at its end."""
        self.data = data
        self.eights = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
        self.slots = np.full(1 << 10, -1, np.int64)  # -1: free, else the word's number, else -2 - its place among those now entering
        self.words = np.empty((4, 0), np.int64)  # start, length, document and hash by number

    def _eight(self, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
        """The bytes ``at`` to ``at + 8`` of every span, zeros after its end."""
        return self.eights[start + at] & _LOW_BYTES[np.minimum(length - at, 8)]

    def _hash(self, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
        code = (doc.astype(np.uint64) + np.uint64(1)) * _MIX + length.astype(np.uint64)
        live = np.arange(len(start))
        for at in range(0, SHORT, 8):
            if not len(live):
                break
            mixed = (code[live] ^ self._eight(start[live], length[live], at)) * _MIX
            code[live] = mixed ^ (mixed >> _SHIFT)
            live = live[length[live] > at + 8]
        for i in live:
            code[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.data[start[i] : start[i] + length[i]]))
        return code.view(np.int64)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans ``a`` and ``b`` (columns as in ``words``) are one word of one document."""
        same = (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
        live = np.flatnonzero(same & (a[0] != b[0]))
        for at in range(0, SHORT, 8):
            if not len(live):
                break
            length = a[1][live]
            differ = self._eight(a[0][live], length, at) != self._eight(b[0][live], length, at)
            same[live[differ]] = False
            live = live[~differ & (length > at + 8)]
        for i in live:
            one, other = (self.data[x[0][i] : x[0][i] + x[1][i]] for x in (a, b))
            same[i] = np.array_equal(one, other)
        return same

    def _grow(self, more: int) -> None:
        if 2 * (self.words.shape[1] + more) <= len(self.slots):
            return
        self.slots = np.full(1 << (2 * (self.words.shape[1] + more)).bit_length(), -1, np.int64)
        mask = len(self.slots) - 1
        left = np.arange(self.words.shape[1])
        place = self.words[3] & mask
        while len(left):
            free = left[self.slots[place[left]] == -1]
            self.slots[place[free]] = free
            left = left[self.slots[place[left]] != left]
            place[left] = (place[left] + 1) & mask

    def insert(self, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Enter the spans; the documents of those that no earlier span equals."""
        if not len(start):
            return doc
        self._grow(len(start))
        mask = len(self.slots) - 1
        new = np.stack([start, length, doc, self._hash(start, length, doc)])
        place = new[3] & mask
        left = np.arange(len(start))
        while len(left):
            free = left[self.slots[place[left]] == -1]
            self.slots[place[free]] = -2 - free  # one of them stays
            held = self.slots[place[left]]
            other = new[:, np.maximum(-2 - held, 0)]
            known = held >= 0
            other[:, known] = self.words[:, held[known]]
            left = left[~self._equal(new[:, left], other)]
            place[left] = (place[left] + 1) & mask
        owners = np.flatnonzero(self.slots[place] == -2 - np.arange(len(start)))
        self.slots[place[owners]] = self.words.shape[1] + np.arange(len(owners))
        self.words = np.concatenate([self.words, new[:, owners]], axis=1)
        return doc[owners]


def _stretches(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``STRETCH`` bytes; a longer document is a run of its own."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STRETCH, "right")) - 1)
        yield first, last
        first = last


def _read(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of the documents between ``bounds``; one row per count."""
    docs = len(bounds) - 1
    counts = np.zeros((5, docs), np.int64)
    table = SpanTable(np.concatenate([data, np.zeros(8, np.uint8)]))
    begins_doc = bounds[:-1][np.diff(bounds) > 0]  # an empty document has no byte
    open_start = -1  # where the word that the last part ended in begins
    for lo in range(0, len(data), STRETCH):
        hi = min(lo + STRETCH, len(data))
        classes = CLASSES[data[lo:hi]]
        before = np.empty(hi - lo, np.uint8)
        before[1:] = FOLLOWS[_GAP][classes[:-1]]
        before[0] = _WORD if open_start >= 0 else _GAP
        breaks = begins_doc[np.searchsorted(begins_doc, lo) : np.searchsorted(begins_doc, hi)]
        before[breaks - lo] = _GAP
        emitted = EMITS.ravel()[before * 6 + classes]
        place = np.searchsorted(bounds, lo, "right") - 1
        heads = np.r_[lo, breaks[breaks > lo]]
        owner = np.r_[place, np.searchsorted(bounds, heads[1:], "right") - 1]
        for row, bit in ((0, _BEGINS), (2, _IS_CAPITAL), (3, _IS_POINT), (4, _IS_SYMBOL)):
            counts[row][owner] += np.add.reduceat((emitted & bit) != 0, heads - lo, dtype=np.int64)
        starts = np.flatnonzero(emitted & _BEGINS) + lo
        # a word ends before white space, before the next document and at the end of the last one
        stops = classes == _WHITE
        stops[breaks - lo] = True
        inside = np.r_[open_start >= 0, classes != _WHITE]
        ends = np.flatnonzero(inside[:-1] & stops) + lo
        if inside[-1] and hi == len(data):
            ends = np.r_[ends, hi]
        if open_start >= 0:
            starts = np.r_[open_start, starts]
        open_start = int(starts[-1]) if len(starts) > len(ends) else -1
        starts = starts[: len(ends)]
        entered = table.insert(starts, ends - starts, np.searchsorted(bounds, starts, "right") - 1)
        counts[1] += np.bincount(entered, minlength=docs)
    return counts


def count_texts(texts: list[bytes]) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of every text; one row per count."""
    bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    out = [np.zeros((5, 0), np.int64)]
    for first, last in _stretches(bounds):
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        out.append(_read(data, bounds[first : last + 1] - bounds[first]))
    return np.concatenate(out, axis=1)


COUNTS = ("words", "distinct", "capitals", "points", "symbols")


def text_counts(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, words, distinct, capitals, points, symbols, digest`` of every row; ``digest`` is the text's SHA-256.

    Words are runs of other than ASCII white space, case-sensitive; capitals are A-Z. A null text is empty and a null
    part is the empty string. A byte that begins no character counts none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = payloads(batch.column("text"))
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), *map(pa.array, count_texts(texts)), pa.array(digests, pa.binary())],
                names=["doc_id", "part", *COUNTS, "digest"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text"
    )
    return rows.mapInArrow(run, f"doc_id long, part string, {', '.join(f'{c} long' for c in COUNTS)}, digest binary")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _own_failures() -> Column:
    """Bits of the conditions that a document's own counts decide."""
    conditions = {
        "A": F.col("words") < MIN_WORDS,
        "B": 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"),
        "C": 100 * F.col("capitals") > CAPITAL_PERCENT * F.col("points"),
        "D": F.col("symbols") > 0,
    }
    return reduce(Column.__add__, [F.when(c, _bit(f)).otherwise(0) for f, c in conditions.items()])


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good ones and toxic ones per part and set of failed filters.

    Condition E holds for a text that a row with a smaller id has as well. Rows without an id are neither: they fail
    no E and make no other row fail it. Rows with the same id and text are counted each, and all of them stand or fall
    together. A label counts if any label row of the id has it; rows without an id have no label.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows without an id are dealt by their text, as all of them would meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    counted = text_counts(docs, part).select("doc_id", spread.alias("spread"), "part", "digest", _own_failures().alias("mask"))
    alike = counted.groupBy("doc_id", "spread", "part", "digest", "mask").agg(F.count("*").alias("n"))
    joined = alike.join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = materialise(joined.select("doc_id", "part", "digest", "mask", "n", yes("good").alias("good"), yes("toxic").alias("toxic")), "marked")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    groups = ["part", "mask", "good", "toxic"]
    every = rows.groupBy(*groups).agg(F.sum("n").alias("n"))
    original = rows.join(firsts, ["doc_id", "digest"], "left_semi").unionByName(rows.where("doc_id IS NULL"))
    passes = original.groupBy(*groups).agg(F.sum("n").alias("passing"))
    both = every.join(passes, groups, "left").withColumn("passing", F.coalesce("passing", F.lit(0)))
    split = F.explode(
        F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )
    )
    found = both.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.*")
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What five filters remove per part, in each of their 120 orders, step by step.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; one row per
    part, order and step, with zeros. ``shapley`` is what the step's filter removes, summed over all orders: a document
    that fails k filters goes by each of them in 120 / k orders. See ``failures`` for odd rows; an empty table has no
    parts and gives no rows.
    """
    by_mask = failures(docs, labels, part)
    # at most one entry per set of filters
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn(
        "step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))]))
    )
    place = lambda f: F.instr("filter_order", f)
    steps = steps.withColumn("own", reduce(Column.__add__, [F.when(place(f) == F.col("step"), _bit(f)).otherwise(0) for f in FILTERS]))
    steps = steps.withColumn("earlier", reduce(Column.__add__, [F.when(place(f) < F.col("step"), _bit(f)).otherwise(0) for f in FILTERS]))

    def total(condition, value) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda a, s: a + F.when(condition(s["mask"]), value(s)).otherwise(0))

    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    here = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m) & ~gone(m), lambda s: s["n"]).alias("kept"),
        total(here, lambda s: s["n"]).alias("removed"),
        total(lambda m: fails(m) & gone(m), lambda s: s["n"]).alias("redundant"),
        total(lambda m: m == own, lambda s: s["n"]).alias("unique_fails"),
        total(here, lambda s: s["good"]).alias("good_lost"),
        total(here, lambda s: s["toxic"]).alias("toxic_lost"),
        total(fails, lambda s: (s["n"] * len(orders) / F.bit_count(s["mask"])).cast("long")).alias("shapley"),
    )
