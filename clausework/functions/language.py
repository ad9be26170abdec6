"""Language tags and a native language detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.expr import once
from clausework.functions.text import WS

# Frequent function words per language; a word may serve several languages.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "you", "this", "are", "or", "not"),
    "fr": ("le", "la", "les", "et", "un", "une", "des", "du", "est", "que", "pour", "dans", "qui", "vous", "avec"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von", "sie", "auf", "im"),
    "es": ("el", "los", "las", "y", "una", "es", "por", "con", "para", "se", "del", "su", "al", "lo", "como"),
}


def is_english(language: Column) -> Column:
    """True when the tag is present and starts with ``en`` in any case."""
    return F.coalesce(F.lower(language).startswith("en"), F.lit(False))


def detect_language(text: Column, stop_words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Language with most distinct function words in ``text``; null when none occurs.

    A tie goes to the language listed first. This is a rule, not a statistical model.
    """
    lists = stop_words or STOP_WORDS
    tokens = F.array_distinct(F.split(F.lower(text), f"{WS}+"))

    def best(words: Column) -> Column:
        scored = [
            F.struct(
                F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed]))).alias("hits"),
                F.lit(-order).alias("prior"),
                F.lit(code).alias("code"),
            )
            for order, (code, listed) in enumerate(lists.items())
        ]
        return F.array_max(F.array(*scored))

    return once(once(tokens, best), lambda winner: F.when(winner["hits"] > 0, winner["code"]))
