"""What several operators share: row keys, UTF-8 payloads, ASCII words and hashed shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of [\x20\x09-\x0D] and the letters that ASCII lower-casing changes.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# distinct words a task remembers the hashes of, some 150 bytes each; idle workers keep that memory while other stages run
WORD_CACHE = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes that identify a row by its id and text; null ids and repeated ids keep apart."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit(1), id_col).alias("k2")]


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of some columns, as ``h1, h2``."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2")]


def payloads(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


class WordHashes(dict):
    """64-bit hashes by word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes methods know no other letters)."""
    return text.lower().split()


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; shorter texts are one run, empty ones none."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    n = len(hashes) - width + 1
    mixed = hashes[:n] + np.uint64(width)
    for j in range(1, width):
        mixed = (mixed ^ (mixed >> _SHIFT)) * _MIX + hashes[j : j + n]
    return np.unique((mixed ^ (mixed >> _SHIFT)) * _MIX)
