"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of both end together at some byte offsets; those cut a text into groups. An interval is halved at a common end
near its middle, found by bisecting one side's ends for the other's, and both halves are treated alike; an interval
without an inner common end is a group. Neither tokenizer joins anything across the start of a space-led word or a line,
so such a place is a shared cut from the outset, and what lies between two of them is encoded and halved once per block
of documents, however often it stands there.

Which tokens go together over the whole corpus takes one exchange: a block of documents sends each pair of ids once with
its count, and gets the pair's total back. Documents' own token lists never leave their block's rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausework.llm.common import payloads
from clausework.operators.lineage import materialise

# UTF-8 bytes of text that share one list of id pairs; a longer text is a block of its own
BLOCK_BYTES = 8 << 20
# stretches that are encoded at a time
ENCODE_AT_ONCE = 8_192

# Fixed value: the character that stands for a space in pieces.
MARK = "▁"
# U+180E is white space to some regular expression engines only
_SOLID = r"[^\s᠎]"
# Fixed value: how byte-level tokenizers part a text before they merge bytes.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters beyond those whose classes no version of Unicode has changed
_RARE = re.compile("[^\x00-\u024f]")
# white space other than single spaces and line ends between solid characters
_UNEVEN = re.compile(r"[^\S \n]|᠎|[ \n][ \n]|\A[ \n]|[ \n]\Z")

_DOC, _BLOCK, _PAIR = 0, 1, 2


@dataclass(frozen=True)
class Tokenizers:
    """The two tokenizers' files as bytes; a few megabytes, sent to the tasks with the code."""

    byte_level: bytes
    pieces: bytes


def read_tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """``byte_level``: a byte-level BPE file (JSON); ``pieces``: a piece model with byte fallback."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return Tokenizers(a.read(), b.read())


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def shared_groups(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` after each group, in order.

    ``a`` and ``b`` are rising byte offsets. Interval ``i`` is ``a[a_bounds[i]:a_bounds[i + 1]]`` and the like of ``b``,
    and both end at one offset. Every round halves all intervals that are still open: from the middle of the interval
    outwards, the first of its ends in ``a`` that a bisection of ``b`` finds as well is the cut. Offsets of other intervals
    are never equal, so one search serves all.
    """
    done = []
    todo = np.stack([a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]]).astype(np.int64)
    todo = todo[:, todo[1] > todo[0]]
    while todo.shape[1]:
        cut = np.full((2, todo.shape[1]), -1)
        middle = (todo[0] + todo[1] - 1) // 2
        left = np.flatnonzero((todo[1] - todo[0] > 1) & (todo[3] - todo[2] > 1))
        step = 0
        while len(left):
            for i in (middle[left] - step, middle[left] + step) if step else (middle[left],):
                inside = (i >= todo[0][left]) & (i < todo[1][left] - 1) & (cut[0][left] < 0)
                at, i = left[inside], i[inside]
                j = np.searchsorted(b, a[i])
                found = b[j] == a[i]
                cut[:, at[found]] = i[found] + 1, j[found] + 1
            step += 1
            left = left[(cut[0][left] < 0) & ((middle[left] - step >= todo[0][left]) | (middle[left] + step < todo[1][left] - 1))]
        open_ = cut[0] >= 0
        done.append(todo[:, ~open_][[1, 3]])
        (a_lo, a_hi, b_lo, b_hi), (p, q) = todo[:, open_], cut[:, open_]
        todo = np.concatenate([[a_lo, p, b_lo, q], [p, a_hi, q, b_hi]], axis=1)
    after = np.concatenate([np.empty((2, 0), np.int64), *done], axis=1)
    after = after[:, np.argsort(after[0])]
    return after[0], after[1]


@dataclass(frozen=True)
class Aligned:
    """Stretches' ids and byte ends on either side, and their groups. A stretch that isn't ``sound`` has no tokens."""

    sound: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_bounds: np.ndarray  # where each stretch's tokens begin, and the end
    b_bounds: np.ndarray
    a_after: np.ndarray  # places after each group
    b_after: np.ndarray
    group_bounds: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all pairs of tokens whose byte ranges overlap, in order, and where each stretch's begin.

        Between two ends of either side lies one pair.
        """
        ends = np.union1d(self.a_ends, self.b_ends)
        i, j = np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)
        return i, j, np.searchsorted(i, self.a_bounds)

    def written(self, names: list[str]) -> list[str]:
        """Each stretch's groups as ``a1,a2|b1;a3|b2,b3``; ``names`` are the ids as text with ``,``, ``|`` and ``;`` behind."""
        # tokens in the order of group, side and place, each with what follows it
        a_group = np.searchsorted(self.a_after, np.arange(len(self.a)), "right")
        b_group = np.searchsorted(self.b_after, np.arange(len(self.b)), "right")
        order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
        named = 3 * np.r_[self.a, self.b].astype(np.int64)
        named[self.a_after - 1] += 1
        named[len(self.a) + self.b_after - 1] += 2
        parts = list(map(names.__getitem__, named[order].tolist()))
        bounds = (self.a_bounds + self.b_bounds).tolist()
        return ["".join(parts[lo:hi])[:-1] for lo, hi in zip(bounds, bounds[1:])]


def _encoded(table: list[bytes], raw: list[bytes], lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids one after the other, their number per stretch, and which stretches' ids give its bytes back."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, counts.sum())
    pieces = list(map(table.__getitem__, flat.tolist()))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
    whole = np.array_equal(ends, np.cumsum(list(map(len, raw)))) and b"".join(pieces) == b"".join(raw)
    if whole:
        return flat, counts, np.ones(len(raw), bool)
    sound = np.array([b"".join(map(table.__getitem__, ids)) == r for ids, r in zip(lists, raw)], bool)
    return flat, counts, sound


class Aligner:
    """Both tokenizers, and how their tokens stand to each other in a text."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.one = Tokenizer.from_str(files.byte_level.decode())
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        written = _byte_characters()
        self.quick = self._quick(json.loads(files.byte_level), written)
        names = (self.one.id_to_token(i) or "" for i in range(self.one.get_vocab_size()))
        self.a_bytes = [bytes(map(written.get, p)) if all(c in written for c in p) else b"" for p in names]
        pieces = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.two.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]
        # no piece may run over a cut
        inner = [p for i, p in enumerate(pieces) if not (self.two.is_control(i) or self.two.is_byte(i))]
        starts = [c for c, m in ((" ", MARK), ("\n", "\n")) if not any(m in p.lstrip(m) or (c == "\n" and c in p) for p in inner)]
        self.cut = re.compile(f"(?<={_SOLID})(?=[{''.join(starts)}]{_SOLID})") if starts else None
        self.cuts_both = len(starts) == 2

    @staticmethod
    def _quick(spec: dict, written: dict[str, int]) -> Callable[[str], list[int]] | None:
        """The byte-level tokenizer as ranked merges, which are faster, if its file says no more than that."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        made = [vocab.get(a + b, -1) for a, b in pairs]
        if not plain or any(a >= b for a, b in zip(made, made[1:])) or len(vocab.keys() & written.keys()) < 256 or made[0] < 256:
            return None
        ranks = {bytes(map(written.get, p)): i for p, i in vocab.items() if len(p) == 1 or i >= made[0] and all(c in written for c in p)}
        return tiktoken.Encoding("byte-level", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _first_ids(self, stretches: list[str]) -> list[list[int]]:
        rare = [i for i, s in enumerate(stretches) if not self.quick or _RARE.search(s)]
        if not rare:
            return list(map(self.quick, stretches))
        slow = iter(self.one.encode_batch_fast([stretches[i] for i in rare], add_special_tokens=False))
        at = set(rare)
        return [next(slow).ids if i in at else self.quick(s) for i, s in enumerate(stretches)]

    def stretches(self, text: str) -> list[str]:
        """The text with a space in front, cut before single spaces and single line ends inside it."""
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def names_of(self, text: str) -> list[str]:
        """Names of the text's stretches: those of a space and a solid character go by what follows the space."""
        if self.cuts_both and not _UNEVEN.search(text):
            return text.replace("\n", " \n").split(" ")  # the same, faster, where white space is single and inside
        return [s[1:] if s[0] == " " and s[1:2].strip(" \n") else s for s in self.stretches(text)]

    def align(self, stretches: list[str]) -> Aligned:
        """Stretches encoded and cut into groups. The piece model puts a space in front of what it is given."""
        sides: list[list] = [[], []]
        sounds = [np.empty(0, bool)]
        for lo in range(0, len(stretches), ENCODE_AT_ONCE):
            some = stretches[lo : lo + ENCODE_AT_ONCE]
            raw = [s.encode() for s in some]
            one = self._first_ids(some)
            two = self.two.encode([s[1:] if s[0] == " " else s for s in some], num_threads=1)
            two = [ids if s[0] == " " else ids[1:] for s, ids in zip(some, two)]
            found = [_encoded(table, raw, lists) for table, lists in ((self.a_bytes, one), (self.b_bytes, two))]
            sound = found[0][2] & found[1][2]
            for side, (flat, counts, _) in zip(sides, found):
                side.append((flat[np.repeat(sound, counts)], np.where(sound, counts, 0)))
            sounds.append(sound)
        (a, a_bounds), (b, b_bounds) = (
            (np.concatenate([x for x, _ in side] or [np.empty(0, np.int32)]), np.r_[0, np.cumsum(np.concatenate([c for _, c in side] or [[]]))].astype(np.int64))
            for side in sides
        )
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_after, b_after = shared_groups(a_ends, b_ends, a_bounds, b_bounds)
        group_bounds = np.r_[0, np.searchsorted(a_after, a_bounds[1:], "right")]
        return Aligned(np.concatenate(sounds), a, b, a_ends, b_ends, a_bounds, b_bounds, a_after, b_after, group_bounds)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


class _Numbers(dict):
    """Numbers by stretches' names, in the order of their first places."""

    def __missing__(self, name: str) -> int:
        value = self[name] = len(self)
        return value


class _Block:
    """The documents of a block, as numbers of its distinct stretches."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.numbers = _Numbers()
        self.ids: list[int | None] = []
        self.lists: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        text = raw.decode(errors="replace")
        names = self.aligner.names_of(text) if raw and text.encode() == raw else []
        self.ids.append(doc_id)
        self.lists.append(np.fromiter(map(self.numbers.__getitem__, names), np.int32, len(names)))
        self.bytes += len(raw)

    def rows(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per document, one with the links of the block's stretches, one per pair of ids."""

        def batch(kind: int, rows: int, **columns) -> pa.RecordBatch:
            given = {"kind": pa.array([kind] * rows, pa.int8()), "block": pa.array([block] * rows, pa.int64()), **columns}
            return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

        aligned = self.aligner.align([n if n[0] in " \n" else " " + n for n in self.numbers])
        self.numbers.clear()
        lists = [x if aligned.sound[x].all() else x[:0] for x in self.lists]
        written = aligned.written(self.aligner.names)
        said = (";".join(map(written.__getitem__, x.tolist())) for x in lists)
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
        del written
        first, second, bounds = aligned.links()
        sizes = np.stack([np.diff(x) for x in (aligned.a_bounds, aligned.b_bounds, aligned.group_bounds, bounds)], axis=1)
        ends = np.r_[0, np.cumsum(list(map(len, lists)), dtype=np.int64)]
        numbers = np.concatenate([*lists, np.empty(0, np.int32)])
        totals = np.stack([_sums(sizes[numbers, i], ends) for i in range(4)])
        yield batch(
            _DOC,
            len(lists),
            doc_id=pa.array(self.ids, pa.int64()),
            groups_sha256=pa.array(digests, pa.string()),
            numbers=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers)),
            **{c: pa.array(totals[i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        )
        pairs, place = np.unique(aligned.a[first].astype(np.int64) << 32 | aligned.b[second], return_inverse=True)
        yield batch(
            _BLOCK,
            1,
            numbers=pa.ListArray.from_arrays(pa.array([0, len(bounds)], pa.int32()), pa.array(bounds.astype(np.int32))),
            links=pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), pa.array(place.astype(np.int32))),
        )
        # a stretch that only texts without tokens have is in no list and counts nothing
        times = np.bincount(numbers, minlength=len(sizes))
        n = np.bincount(place, np.repeat(times, sizes[:, 3]), len(pairs)).astype(np.int64)
        for lo in range(0, len(pairs), 10_000):
            some = slice(lo, min(lo + 10_000, len(pairs)))
            yield batch(
                _PAIR,
                some.stop - lo,
                place=pa.array(np.arange(lo, some.stop, dtype=np.int32)),
                a=pa.array((pairs[some] >> 32).astype(np.int32)),
                b=pa.array((pairs[some] & 0xFFFFFFFF).astype(np.int32)),
                n=pa.array(n[some]),
            )


_STAGE = pa.schema(
    [
        ("kind", pa.int8()),
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
        ("groups_sha256", pa.string()),
        ("numbers", pa.list_(pa.int32())),
        ("links", pa.list_(pa.int32())),
        *((c, pa.int32()) for c in ("place", "a", "b")),
        ("n", pa.int64()),
    ]
)
_STAGE_DDL = (
    "kind byte, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "numbers array<int>, links array<int>, place int, a int, b int, n long"
)
_RESULT_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _blocks(docs: DataFrame, files: Tokenizers) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, done = Aligner(shared.value), 0
        first = TaskContext.get().partitionId() << 32
        block = _Block(aligner)
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), payloads(batch.column("text"))):
                if block.ids and block.bytes + len(raw) > BLOCK_BYTES:
                    yield from block.rows(first + done, _STAGE)
                    block, done = _Block(aligner), done + 1
                block.add(doc_id, raw)
        if block.ids:
            yield from block.rows(first + done, _STAGE)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(run, _STAGE_DDL), "aligned")


def _block_totals(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with what their links' pairs count over the corpus."""
    left = left.combine_chunks()
    kinds = left["kind"].to_numpy()
    own = left.filter(pa.array(kinds == _BLOCK))
    docs = left.filter(pa.array(kinds == _DOC)).combine_chunks()
    bounds, links = (own[c].combine_chunks().flatten().to_numpy() for c in ("numbers", "links"))
    size = len(right)
    values = np.zeros((2, size), np.int64)
    places = right["place"].to_numpy()
    values[0, places], values[1, places] = right["total"].to_numpy(), right["best"].to_numpy().astype(np.int64)
    lists = docs["numbers"].combine_chunks()
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    numbers = lists.flatten().to_numpy()
    count_sum, n_best = (_sums(_sums(v[links], bounds)[numbers], ends) for v in values)
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": docs["groups_sha256"]}
    return pa.table(columns)


def alignment(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Both tokenizers encode the text with a space in front, special tokens' strings being plain text. ``n_links`` counts
    the pairs of tokens whose byte ranges overlap; a pair of ids counts as often as the corpus links it. ``n_best`` are
    the links whose pair counts most of all pairs of its second id, ties included; ``count_sum`` adds up the links'
    counts. ``groups_sha256`` is the hash of the groups' ids written as ``a1,a2|b1;a3|b2,b3``.

    A null or empty text, one that isn't UTF-8, and one whose tokens on either side don't give its bytes back have no
    tokens: zeros, and an empty string in place of the hash. Null ids and repeated rows are rows like any other. A text
    longer than a block is a block of its own; all that is held of it is its stretches' numbers.
    """
    stage = _blocks(docs, files)
    pairs = stage.where(F.col("kind") == _PAIR).select("block", "place", "a", "b", "n")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    # an id of one side goes with at most as many as the other has
    top = F.max("total").over(W.partitionBy("b"))
    totals = totals.withColumn("best", F.col("total") == top)
    back = pairs.join(totals, ["a", "b"]).select(F.col("block").alias("of"), "place", "total", "best")
    own = stage.where(F.col("kind") != _PAIR).drop("place", "a", "b", "n")
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_block_totals, _RESULT_DDL)


def aligned_groups(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """``doc_id, group, start, end, a, b``: the groups of every text, in order, with both sides' ids.

    ``start`` and ``end`` are byte offsets into the text with a space in front. Texts without tokens have no groups.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("group", "start", "end")), *((c, pa.list_(pa.int32())) for c in "ab")]
    )

    def groups(aligner: Aligner, doc_id: int | None, raw: bytes) -> Iterator[tuple]:
        text = raw.decode(errors="replace")
        found = aligner.align(aligner.stretches(text) if raw and text.encode() == raw else [])
        if not found.sound.all():
            return
        i = j = start = 0
        for number, (p, q) in enumerate(zip(found.a_after.tolist(), found.b_after.tolist())):
            end = int(found.a_ends[p - 1])
            yield doc_id, number, start, end, found.a[i:p].tolist(), found.b[j:q].tolist()
            i, j, start = p, q, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), payloads(batch.column("text"))):
                if rows := list(groups(aligner, doc_id, raw)):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, group long, start long, end long, a array<int>, b array<int>")
