"""A language detector fitted to labelled texts: naive Bayes over character trigrams.

Trigrams are hashed to a fixed number of places, so a model is a list of whole numbers per language and scoring is a sum
of array elements: no lookup table to join, and the same result in any engine. Column functions find a text's letters;
trigrams are counted and scored in NumPy, batch by batch, as a lambda per trigram and language takes three times as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausework.functions.expr import once

PLACES = 4096
# languages whose counts a task holds before it sends them
HELD_LANGUAGES = 1000
# log-probabilities are whole numbers of this fraction, so that sums are exact
SCALE = 1000


def letters_of(text: Column) -> Column:
    """The text's letters in lower case, words parted by one space, a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def trigram_places(text: Column) -> Column:
    """The places of all runs of three characters of the text's letters, words parted by one space. The text is read whole."""
    letters = letters_of(text)
    codes = F.transform(F.regexp_extract_all(letters, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))

    def places(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(c) - 3)
        runs = F.transform(starts, lambda i: F.pmod(c[i] * 961 + c[i + 1] * 31 + c[i + 2], F.lit(PLACES)).cast("int"))
        return F.when(F.size(c) >= 3, runs).otherwise(F.array().cast("array<int>"))

    return once(codes, places)


@dataclass(frozen=True)
class LanguageModel:
    """``scores[language][place]``: the scaled log-probability of a trigram place; languages in order."""

    scores: dict[str, list[int]]

    def detect(self, text: Column) -> Column:
        """The likeliest language of the whole text; null without letters. A tie goes to the language that sorts first."""
        languages = sorted(self.scores)
        if not languages:
            return F.when(F.lit(False), "")

        table = np.array([self.scores[x] for x in languages]).T

        @F.pandas_udf("string")
        def best(letters: pd.Series) -> pd.Series:
            def likeliest(text: str | None) -> str | None:
                places = places_of(text)
                if not (places != _BLANK).any():
                    return None
                return languages[int(table[places].sum(axis=0).argmax())]

            return pd.Series([likeliest(x) for x in letters], dtype=object)

        return best(letters_of(text))


# where three spaces fall: a text without letters is spaces only
_BLANK = (32 * 961 + 32 * 31 + 32) % PLACES


def places_of(letters: str | None) -> np.ndarray:
    """``trigram_places`` of a text whose letters are given."""
    c = np.frombuffer((letters or "").encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % PLACES


def trigram_counts(texts: DataFrame) -> DataFrame:
    """``lang, place, count`` of the trigrams in all texts; ``texts`` has ``lang, letters``.

    A task sends sums, at most ``PLACES`` rows a language for each time that it has held ``HELD_LANGUAGES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "place", "count"])

        for batch in batches:
            for lang, letters in zip(batch.column("lang").to_pylist(), batch.column("letters").to_pylist()):
                if lang not in held and len(held) >= HELD_LANGUAGES:
                    yield from sums()
                    held.clear()
                n = held.setdefault(lang, np.zeros(PLACES, np.int64))
                n += np.bincount(places_of(letters), minlength=PLACES)
        yield from sums()

    partial = texts.select("lang", "letters").mapInArrow(run, "lang string, place long, count long")
    return partial.groupBy("lang", "place").agg(F.sum("count").alias("count"))


def fit_languages(texts: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Fit a model to all texts of every language.

    Counts are summed in the tasks; at most ``PLACES`` numbers per language come to the driver. Rows without a language
    or a text are left out. Places that no text of a language has count as seen once.
    """
    known = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = trigram_counts(known.select(F.col(lang).alias("lang"), letters_of(F.col(text)).alias("letters")))
    total = F.sum("count").over(W.partitionBy("lang"))
    chance = F.round(SCALE * F.log((F.col("count") + 1) / (total + PLACES))).cast("int")
    none = F.round(SCALE * F.log(F.lit(1) / (total + PLACES))).cast("int")
    found = counts.select("lang", "place", chance.alias("chance"), none.alias("none"))
    scores: dict[str, list[int]] = {}
    for r in found.collect():
        scores.setdefault(r["lang"], [r["none"]] * PLACES)[r["place"]] = r["chance"]
    return LanguageModel(scores)
