"""Line deduplication over a corpus: keep bitmaps per document from one sorted stream of line hashes.

Line hashes are range-partitioned with a secondary sort by document (largest first) and position. A task streams its
range, keeps the lines of the first document of every key and marks the others once the key has been seen in enough
documents. A key that holds a large share of all lines spreads over several ranges, as the document is part of the
range key; at most two keys per range are open at an edge, and those are settled from a summary of a few rows per range.
Texts take no part in the sort: what comes back is a compressed bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.common import LOWER, UPPER, WHITE, hash128, row_key
from clausework.operators.lineage import materialise

MIN_CHARS = 20
MIN_DOCS = 3
# stands for a null id: such rows form one document that is smaller than any other
NO_ID = -(2**63)

_SURE, _OPEN, _EDGE = 0, 1, 2


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc, k1, k2, pos`` of every line whose key is long enough."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        *row_key("doc_id", "text"),
        F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    )
    key = F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER)
    keyed = lines.select("doc", "k1", "k2", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(*hash128(F.col("key")), "doc", "k1", "k2", "pos")


def _stream(min_docs: int):
    """Marks of one sorted range: sure drops, rows that hang on other ranges, and the documents of the keys at its edges.

    Held in memory: rows of fewer than ``min_docs`` documents of the current key.
    """
    schema = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("h1", "h2", "doc", "k1", "k2")), ("pos", pa.int32())])

    def emit(kind: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(rows[0]):
            kinds = pa.array(np.full(len(rows[0]), kind, np.int8))
            yield pa.RecordBatch.from_arrays([kinds, *map(pa.array, rows)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last_doc = None
        last_rank = 0
        opening = True  # still in the key that the range begins with
        held: list[list[np.ndarray]] = []  # rows that go once the current key has enough documents
        edge: list[list[np.ndarray]] = []  # first rows of the current key's first documents
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(6)]
            h1, h2, doc = rows[:3]
            if not len(h1):
                continue
            goes_on = key == (h1[0], h2[0])
            new_key = np.r_[not goes_on, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[not goes_on or doc[0] != last_doc, doc[1:] != doc[:-1]]
            run_no = np.cumsum(new_key) - (0 if goes_on else 1)  # 0: the key that goes on, or the first one
            starts = np.flatnonzero(np.r_[True, new_key[1:]])
            seen = np.cumsum(new_doc)
            base = seen[starts]
            if goes_on:
                base[0] = -last_rank
            rank = seen - base[run_no]  # place of the row's document within its key
            top = np.maximum.reduceat(rank, starts)
            if key is not None and not goes_on:
                opening = False
            in_opening = (run_no == 0) & opening
            if goes_on and not opening and top[0] >= min_docs - 1:
                for rest in held:
                    yield from emit(_SURE, rest)
                held = []
            if not goes_on or len(starts) > 1:
                held_now: list[list[np.ndarray]] = []
            else:
                held_now = held
            waiting = (rank >= 1) & (rank < min_docs - 1) & ~in_opening
            settled = top[run_no] >= min_docs - 1
            yield from emit(_SURE, [c[(rank >= min_docs - 1) | (waiting & settled)] for c in rows])
            last_run = run_no == len(starts) - 1
            tail = waiting & ~settled & last_run
            if tail.any():
                held_now.append([c[tail] for c in rows])
            yield from emit(_OPEN, [c[in_opening & (rank < min_docs - 1)] for c in rows])
            few = new_doc & (rank < min_docs)
            yield from emit(_EDGE, [c[few & in_opening] for c in rows])
            if not goes_on or len(starts) > 1:
                edge = []
            edge.append([c[few & last_run & ~in_opening] for c in rows])
            held = held_now
            opening = opening and len(starts) == 1
            key, last_doc, last_rank = (h1[-1], h2[-1]), doc[-1], int(rank[-1])
        for rest in held:
            yield from emit(_OPEN, rest)
        for rest in edge:
            yield from emit(_EDGE, rest)

    return run


def _drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``k1, k2, pos`` of the lines to drop."""
    lines = materialise(_line_rows(docs, min_chars), "lines")
    ranges = lines.repartitionByRange("h1", "h2", F.desc("doc"), "k1", "pos").sortWithinPartitions(
        "h1", "h2", F.desc("doc"), "k1", "pos"
    )
    marks = materialise(
        ranges.mapInArrow(_stream(min_docs), "kind byte, h1 long, h2 long, doc long, k1 long, k2 long, pos int"), "marks"
    )
    # at most 2 * min_docs rows per range
    edges = (
        marks.where(F.col("kind") == _EDGE)
        .groupBy("h1", "h2")
        .agg(F.max("doc").alias("largest"), F.count_distinct("doc").alias("docs"))
        .where(F.col("docs") >= min_docs)
    )
    late = marks.where(F.col("kind") == _OPEN).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("doc") < F.col("largest"))
    return marks.where(F.col("kind") == _SURE).select("k1", "k2", "pos").unionByName(late.select("k1", "k2", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions to compressed bits; a set bit is a line that stays. Lines after the last bit stay as well."""
    for batch in batches:
        positions = batch.column("positions")
        bits = []
        for one in positions:
            dropped = one.values.to_numpy()
            keep = np.ones((dropped.max() // 8 + 1) * 8, bool)
            keep[dropped] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.array(list(map(len, positions)), pa.int64()), pa.array(bits, pa.binary())],
            names=["k1", "k2", "n_dropped", "keep"],
        )


def line_keep(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``k1, k2, n_dropped, keep`` of every document that loses lines; ``k1, k2`` is ``row_key`` of ``doc_id, text``.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Lines whose key has at
    least ``min_chars`` code points and stands in at least ``min_docs`` documents go, except in the document with the
    largest id. A null or empty text is one empty line. Rows that share an id count as one document; rows that are
    equal in id and text lose the same lines; a null id is one document smaller than all others.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    drops = _drops(docs.select("doc_id", "text"), min_chars, min_docs)
    grouped = drops.groupBy("k1", "k2").agg(F.collect_set("pos").alias("positions"))
    return grouped.mapInArrow(_bitmaps, "k1 long, k2 long, n_dropped long, keep binary")


def _kept(text: bytes, packed: bytes) -> bytes:
    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
    return b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i >= len(keep) or keep[i])


# texts of a batch that are held as bytes at a time
_AT_ONCE = 256


@F.arrow_udf(T.BinaryType())
def _cut(texts: pa.Array, keep: pa.Array) -> pa.Array:
    """The lines that stay of every text with a bitmap; null where either is null."""
    parts = [pa.array([], pa.binary())]
    for lo in range(0, len(texts), _AT_ONCE):
        some = zip(texts.slice(lo, _AT_ONCE).cast(pa.binary()).to_pylist(), keep.slice(lo, _AT_ONCE).to_pylist())
        parts.append(pa.array([None if t is None or p is None else _kept(t, p) for t, p in some], pa.binary()))
    return pa.concat_arrays(parts)


def _with_kept(docs: DataFrame, min_chars: int, min_docs: int, *carried) -> DataFrame:
    """``text, n_dropped, kept`` of every row, and what is carried along; ``kept`` is the bytes of what stays.

    Only texts that lose lines go to the Python workers.
    """
    keyed = docs.select(*carried, "text", *row_key("doc_id", "text"))
    joined = keyed.join(line_keep(docs, min_chars, min_docs), ["k1", "k2"], "left")
    whole = F.col("keep").isNull()
    kept = F.when(whole, F.col("text").cast("binary")).otherwise(_cut(F.when(~whole, F.col("text")), "keep"))
    return joined.withColumns({"n_dropped": F.coalesce("n_dropped", F.lit(0)), "kept": kept}).drop("k1", "k2", "keep")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines that ``line_keep`` gives up taken out of ``text``; other columns as they are."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.lit(0).alias("_")).alias("row")
    rows = _with_kept(docs, min_chars, min_docs, others)
    return rows.select(*[F.col("kept").cast("string").alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row: the counts and the hash of what stays."""
    rows = _with_kept(docs, min_chars, min_docs, F.col("doc_id").cast("long").alias("doc_id"))
    text = F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return rows.select(
        "doc_id",
        (breaks + 1).cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
    )
