"""Paragraph and sentence text.

Java's ``\\s`` is ASCII only and its ``(?U)`` form still misses U+001C to U+001F, so
white space is spelled out as a character class that equals ``str.isspace``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that str.isspace accepts, and the same as members of a regex character class. In the class, Latin
# characters are listed one by one (a bit set in Java) and the others sit behind one range check.
_CODES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACES = "".join(map(chr, _CODES))
_NARROW = "".join(f"\\x{{{code:02x}}}" for code in _CODES if code < 0x100 and code != 0x20)
_WIDE = "[\\x{1680}-\\x{3000}&&[" + "".join(f"\\x{{{code:x}}}" for code in _CODES if code > 0x100) + "]]"
WS_CHARS = rf" {_NARROW}{_WIDE}"
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"

MIN_WORDS = 10


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def non_blank(text: Column) -> Column:
    """True when any character is not white space."""
    return text.rlike(NOT_WS)


def normalise_ws(text: Column) -> Column:
    """Newlines become spaces, then every run of two or more white space characters one space."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), f"{WS}{{2,}}+", " ")


def more_words_than(text: Column, n: int = MIN_WORDS) -> Column:
    """True when ``text`` has strictly more than ``n`` tokens.

    The pattern is anchored and possessive: it stops at token ``n + 1`` and never backtracks,
    so a long paragraph is not scanned to its end.
    """
    return text.rlike(f"^{WS}*+(?:{NOT_WS}++{WS}++){{{n}}}{NOT_WS}")


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(text, F.lit(f"{NOT_WS}++"))


def sanitise_quotes(text: Column) -> Column:
    """Double quotes become single quotes."""
    return F.replace(text, F.lit('"'), F.lit("'"))


def collapse(text: Column) -> Column:
    """Tokens joined by one space. Single spaces, nearly all there is, are passed over rather than replaced."""
    return F.regexp_replace(strip(text), f"{WS}{{2,}}+|[{_NARROW}{_WIDE}]", " ")


def split_sentences(text: Column) -> Column:
    """Array of sentences: tokens up to and including one that ends in ``.``, ``?`` or ``!``; the rest last."""
    parts = F.split(collapse(text), r"(?<=[.?!]) ")
    return F.filter(parts, lambda s: s != "")
