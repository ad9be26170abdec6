"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of a word; dynamic programming carries the
best score and the number of pieces of that path. Ties go the tokenizer's way: of equal scores the longest last piece wins,
and a character is unknown only if no piece is that character. A vocabulary whose pieces hold the space mark in front only
can't join words, so words are counted apart and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The character that stands for a space, and how far an unknown character scores below the worst piece.
MARK = "▁"
UNKNOWN_BELOW = 10.0
# distinct words a task remembers the counts of
CACHE = 500_000


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_fallback: bool  # an unknown character counts as its UTF-8 bytes, else a run of them as one

    @property
    def by_word(self) -> bool:
        return not any(MARK in p.lstrip(MARK) for p in self.pieces)


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file that match text, with their scores; control, unknown and byte pieces don't."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(
        [model.id_to_piece(i) for i in plain],
        [model.get_score(i) for i in plain],
        any(model.is_byte(i) for i in ids),
    )


class Counter:
    """Counts pieces of texts; remembers words."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores) - UNKNOWN_BELOW
        self.bytes = vocabulary.byte_fallback
        self.by_word = vocabulary.by_word
        # a character that no piece holds is always a path's only way on, so it parts what is around it
        self.lines_part = self.bytes and not any("\n" in p for p in vocabulary.pieces)
        # a path's last piece begins at most so far back
        self.window = max(map(len, vocabulary.pieces), default=1) + 1
        self.known: dict[str, int] = {}
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def pieces(self, text: str) -> int:
        """Pieces of the best path over ``text``, whose spaces are marks already."""
        n, window = len(text), self.window
        # of the path to every place: its score, its pieces, and whether its last piece is an unknown character; place i
        # stands at i modulo the window, so a text of any length takes as much memory as its longest piece
        best, count, unknown = [0.0] * window, [0] * window, [False] * window
        found = self.automaton.iter(text)
        end, match = next(found, (n, None))
        here = 0
        for i in range(n):
            to = here + 1 if here + 1 < window else 0
            top, single, pieces, strange = None, False, 0, False
            while end == i:  # longest first
                size, score = match
                back = to - size  # a negative place counts from the window's end
                value = best[back] + score
                if top is None or value > top:
                    top, pieces = value, count[back] + 1
                single |= size == 1
                end, match = next(found, (n, None))
            if not single:
                value = best[here] + self.unknown
                if top is None or value > top:
                    top, strange = value, True
                    pieces = count[here] + (len(text[i].encode()) if self.bytes else int(not unknown[here]))
            best[to], count[to], unknown[to] = top, pieces, strange
            here = to
        return count[here]

    def word(self, word: str) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            if self.lines_part and "\n" in word:
                value = sum(map(self.word, filter(None, word.split("\n")))) + word.count("\n")
            else:
                value = self.pieces(word)
            self.known[word] = value
        return value

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.pieces(marked)
        if MARK * 2 not in marked and MARK not in text:
            word, known = self.word, self.known
            total = 0
            for w in text.split(" "):
                key = MARK + w
                value = known.get(key)
                total += word(key) if value is None else value
            return total
        return sum(map(self.word, self.runs.findall(marked)))


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens`` of every row, over the whole text with a space in front; null and empty texts have none.

    Null ids and repeated rows are rows like any other. A text is read whole, in memory of its longest piece beside the
    text itself, even where it holds no space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(counter.text, texts)), pa.int64())], names=["doc_id", "n_tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long")
