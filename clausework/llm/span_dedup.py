"""Exact removal of long byte strings that occur again, by longest previous factors.

The factor of a suffix is the longest string that begins there and also begins earlier. In the order of all suffixes it is
shared with the nearest suffix before or behind that begins earlier in the text, so two arrays of previous and next smaller
positions give it. To bring the suffixes that matter together without shuffling every suffix, each window of ``length``
bytes is represented by the smallest hash among its short substrings, its anchor. Equal windows have equal anchors at equal
distance. The windows of one anchor occurrence are consecutive and lie in one fragment of the text.

1. Tasks name every fragment by its anchor and by a hash of all its bytes. Fragments that occur again are repeated in full;
   equal ones are merged in the task before anything is shuffled.
2. Where different fragments share an anchor, their bytes are brought together and their suffixes sorted by their bytes, to
   the wanted depth. A window whose longest previous factor reaches ``length`` is a later copy; it and, unless the first is
   kept, the one that it repeats are ranges to remove.
3. An anchor with very many different fragments is split by distance: windows within a range of distances share a longer
   core, so the core takes the anchor's place, down to single windows, which are then only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import payloads, row_key
from clausework.operators.lineage import materialise

LENGTH = 200
# bytes of the substrings that anchors are chosen among
GRAM = 50
# bytes a task hashes at a time; texts beyond are taken alone
CHUNK = 1_000_000
# different fragments of an anchor that one task compares, and bytes it compares at a time
GROUP = 16_384
BATCH = 1_000_000
# ranges of distances an anchor with more fragments is split into, one after the other
WIDTHS = (19, 1)
# tables up to so many rows (40 bytes each) are copied to the tasks; larger ones are joined by shuffle
COPY_ROWS = 1_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 28) - 1)  # low bits of an order key: the place, so that the leftmost of equals is chosen

_SPOTS = "k1 long, k2 long, doc long, lo int, hi int, at int, n long, anchor long, whole long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _fingerprints(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` bytes, by doubling."""
    have, width = _mixed(data.astype(np.uint64) + _MUL), 1
    while width * 2 <= size:
        have = _mixed(have[:-width] * _MUL + have[width:])
        width *= 2
    if width < size:
        have = _mixed(have[: len(have) - (size - width)] * _MUL + have[size - width :] + np.uint64(size))
    return have


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive keys, from running minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, text_of: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor place and anchor hash of every fragment; windows lie inside one text."""
    grams = _fingerprints(data, gram)
    order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (_smallest(order, length - gram + 1) & _PLACE).astype(np.int64)
    inside = text_of[: len(at)] == text_of[length - 1 : length - 1 + len(at)]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (starts,) * 4
    cut = np.r_[True, (at[starts[1:]] != at[starts[:-1]]) | (np.diff(starts) > 1)]
    first = starts[cut]
    last = np.r_[starts[np.flatnonzero(cut)[1:] - 1], starts[-1]]
    return first, last, at[first], grams[at[first]]


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Fragments of all texts, one row for equal ones of a chunk and ``n`` of them; ``n`` 0 marks the others of these."""

    def chunks(batches: Iterator[pa.RecordBatch]):
        """Row keys, places in the text and bytes of texts or pieces of long ones, some megabytes at a time."""
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2", "doc")]
            pieces, rows, froms, size = [], [], [], 0
            for i, text in enumerate(payloads(batch.column("text"))):
                for at in range(0, len(text) - length + 1, CHUNK):
                    piece = text[at : at + CHUNK + length - 1]
                    if pieces and size + len(piece) > CHUNK:
                        yield [k[rows] for k in keys], np.array(froms), pieces
                        pieces, rows, froms, size = [], [], [], 0
                    pieces.append(piece)
                    rows.append(i)
                    froms.append(at)
                    size += len(piece)
            if pieces:
                yield [k[rows] for k in keys], np.array(froms), pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, froms, texts in chunks(batches):
            joined = b"".join(texts)
            sizes = np.array(list(map(len, texts)))
            offsets = np.r_[0, np.cumsum(sizes)]
            text_of = np.repeat(np.arange(len(texts)), sizes)
            first, last, at, anchors = _runs(np.frombuffer(joined, np.uint8), text_of, length, gram)
            whole = np.fromiter(
                (xxhash.xxh3_64_intdigest(joined[a : b + length], c - a) for a, b, c in zip(first.tolist(), last.tolist(), at.tolist())),
                np.uint64,
                len(first),
            )
            text = text_of[first]
            base = offsets[text] - froms[text]
            place = np.lexsort((first - base, keys[1][text], keys[0][text], keys[2][text], whole, anchors))
            new = np.r_[True, (anchors[place][1:] != anchors[place][:-1]) | (whole[place][1:] != whole[place][:-1])][: len(place)]
            heads = np.flatnonzero(new)
            n = np.zeros(len(place), np.int64)
            n[heads] = np.diff(np.r_[heads, len(place)])
            text, base = text[place], base[place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[text]) for k in keys]
                + [pa.array((x[place] - base).astype(np.int32)) for x in (first, last, at)]
                + [pa.array(n), _signed(anchors[place]), _signed(whole[place])],
                names=["k1", "k2", "doc", "lo", "hi", "at", "n", "anchor", "whole"],
            )

    rows = docs.select(*row_key("doc_id", "text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), "text")
    return rows.mapInArrow(run, _SPOTS)


def _sized(df: DataFrame) -> DataFrame:
    """A side of a join that is copied to the tasks only when its rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= COPY_ROWS else df


def _groups(spots: DataFrame) -> DataFrame:
    """Spots whose anchor occurs again, with ``total`` equal fragments and ``kinds`` of fragments of the anchor.

    ``first`` marks the first of equal fragments in text order.
    """
    heads = spots.where("n > 0")
    uses = heads.groupBy("anchor").agg(F.sum("n").alias("uses")).where("uses > 1").select("anchor")
    again = materialise(heads.join(uses, "anchor"), "again")
    place = F.struct("doc", "k1", "k2", "lo")
    equal = again.groupBy("anchor", "whole").agg(F.sum("n").alias("total"), F.min(place).alias("least"))
    kinds = equal.groupBy("anchor").agg(F.count("*").alias("kinds"))
    known = again.join(equal.join(kinds, "anchor"), ["anchor", "whole"])
    return materialise(known.withColumn("first", place == F.col("least")).drop("least"), "groups")


def _fragments(docs: DataFrame, spots: DataFrame, length: int) -> DataFrame:
    """The spots with the bytes of their fragments, cut out before anything but the fragment leaves the text's row."""
    texts = docs.select(*row_key("doc_id", "text"), F.col("text").cast("binary").alias("whole_text"))
    joined = texts.join(_sized(spots), ["k1", "k2"])
    return joined.select(*spots.columns, F.expr(f"substring(whole_text, lo + 1, hi - lo + {length})").alias("bytes"))


class Suffixes:
    """The suffixes of some bytes, compared to a depth of at least eight bytes by what stands there, never by a hash."""

    def __init__(self, data: np.ndarray, depth: int):
        self.depth = depth
        self.size = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray(len(data), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
        # ranks of all substrings of 8, 16, 32, … bytes, then of ``depth``; each from pairs of the ranks before
        self.ranks = [(8, _ranked(self.eights[: max(self.size - 7, 0)]))]
        while self.ranks[-1][0] < depth:
            width, rank = self.ranks[-1]
            step = min(width, depth - width)
            pairs = rank[: max(len(rank) - step, 0)] << 32 | rank[step:]
            self.ranks.append((width + step, _ranked(pairs)))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` begin with alike, up to ``depth``; both have that many bytes."""
        length = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.ranks):
            fits = length + width <= self.depth
            i, j = (np.minimum(x + length, len(rank) - 1) for x in (a, b))
            length += np.where(fits & (rank[i] == rank[j]), width, 0)
        for _ in range(7):  # what is left of the last eight bytes
            i, j = a + length, b + length
            inside = (length < self.depth) & (i < self.size) & (j < self.size)
            i, j = np.minimum(i, self.size - 1), np.minimum(j, self.size - 1)
            length += inside & (self.eights[i] >> np.uint64(56) == self.eights[j] >> np.uint64(56))
        return length


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of every key among the different ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]][: len(keys)])
    return rank


def _smaller_before(place: np.ndarray) -> np.ndarray:
    """For every entry the nearest one before it that is smaller; -1 for none. Skips over what is known to be larger."""
    found = np.arange(-1, len(place) - 1)
    left = np.arange(len(place))
    while len(left):
        left = left[found[left] >= 0]
        left = left[place[found[left]] >= place[left]]
        found[left] = found[found[left]]
    return found


def longest_previous(suffixes: Suffixes, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factors of the suffixes at ``at``, up to the depth, and which suffix holds each earlier.

    ``place`` is where a suffix stands in the texts; those with one place are one another's copies of a row and count as
    neither earlier nor later. Without an earlier suffix the factor is empty and its source -1.
    """
    rank = suffixes.ranks[-1][1][at]
    order = np.lexsort((place, rank))  # the suffix array
    placed = place[order]
    before = _smaller_before(placed)
    behind = len(order) - 1 - _smaller_before(placed[::-1])[::-1]
    factor, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for near in (before, behind):
        some = np.flatnonzero((near >= 0) & (near < len(order)))
        length = suffixes.common(at[order[some]], at[order[near[some]]])
        better = length > factor[some]
        factor[some[better]] = length[better]
        source[some[better]] = order[near[some[better]]]
    out = np.empty_like(factor), np.empty_like(source)
    out[0][order], out[1][order] = factor, source
    return out


def _previous(length: int, keep_first: bool):
    """Repeated windows of fragments that share an anchor, as ranges of starts."""

    def judge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        sizes = np.array([len(r[7]) for r in rows])
        counts = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + step
        # places in text order: by document, then by start
        documents = sorted({(r[4], r[2], r[3]) for r in rows})
        rank = {d: i for i, d in enumerate(documents)}
        doc = np.array([rank[r[4], r[2], r[3]] for r in rows])[row]
        start = np.array([r[5] for r in rows])[row] + step
        factor, source = longest_previous(Suffixes(data, length), at, doc << 32 | start)
        hit = factor >= length
        if not keep_first:
            hit[source[hit]] = True  # the first of equal windows is the source of the next
        found = np.flatnonzero(hit)
        if not len(found):
            return
        cut = np.r_[True, (np.diff(found) > 1) | (row[found[1:]] != row[found[:-1]])]
        begin = found[cut]
        end = np.r_[found[np.flatnonzero(cut)[1:] - 1], found[-1]]
        of = row[begin]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][k] for i in of], pa.int64()) for k in (2, 3)]
            + [pa.array(start[begin].astype(np.int32)), pa.array(start[end].astype(np.int32))],
            names=["k1", "k2", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH and rows[-1][0] != r[0]:
                    yield from judge(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield from judge(rows)

    return run


def _split(fragments: DataFrame, length: int, width: int) -> DataFrame:
    """Spots, with bytes, for narrower ranges of distances: what all windows of a range share takes the anchor's place."""

    def pieces(r: dict) -> Iterator[tuple]:
        lo, at, data = r["lo"], r["at"], r["bytes"]
        begin = lo
        while begin <= r["hi"]:
            turn = (at - begin) // width
            near, far = at - turn * width, at - (turn + 1) * width + 1  # last and first start of the full range
            end = min(r["hi"], near)
            core = xxhash.xxh3_64_intdigest(data[near - lo : far + length - lo], turn)
            anchor = xxhash.xxh3_64_intdigest(f"{r['anchor']}:{width}:{turn}:{core}".encode())
            piece = data[begin - lo : end + length - lo]
            whole = xxhash.xxh3_64_intdigest(piece, at - begin)
            yield r["k1"], r["k2"], r["doc"], begin, end, at, r["total"], anchor, whole, piece
            begin = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()]
        for batch in batches:
            rows = [p for r in batch.to_pylist() for p in pieces(r)]
            columns = list(zip(*rows)) or [()] * 10
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)] + [*map(_signed, columns[7:9]), pa.array(columns[9], pa.binary())],
                names=["k1", "k2", "doc", "lo", "hi", "at", "n", "anchor", "whole", "bytes"],
            )

    return fragments.mapInArrow(run, _SPOTS + ", bytes binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """``k1, k2, lo, hi``: ranges of starts of strings of ``length`` bytes that occur again; ranges may overlap.

    With ``keep_first`` only those that occur earlier, by document id and place. ``k1, k2`` is ``row_key`` of
    ``doc_id, text``. Texts are taken as UTF-8; null is empty; a null id comes before all others. Rows equal in id and
    text count as separate occurrences (with ``keep_first``, none of them is earlier than the other).
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    spots = materialise(_scan(docs, length, gram), "spots")
    found = spots.where("n = 0").select("k1", "k2", "lo", "hi")
    for width in (*WIDTHS, 0):
        groups = _groups(spots)
        whole = ~F.col("first") if keep_first else ~F.col("first") | (F.col("total") > 1)
        found = found.unionByName(groups.where(whole).select("k1", "k2", "lo", "hi"))
        unlike = groups.where("first AND kinds > 1")
        if "bytes" not in spots.columns:
            unlike = materialise(_fragments(docs, unlike, length), "fragments")
        few = unlike.where(F.col("kinds") <= GROUP) if width else unlike
        compared = few.select("anchor", "whole", "k1", "k2", "doc", "lo", "total", "bytes")
        compared = compared.repartition("anchor").sortWithinPartitions("anchor", "whole")
        ranges = compared.mapInArrow(_previous(length, keep_first), "k1 long, k2 long, lo int, hi int")
        found = found.unionByName(materialise(ranges, "ranges"))
        many = unlike.where(F.col("kinds") > GROUP)
        if not width or many.isEmpty():
            break
        spots = materialise(_split(many, length, width), "spots")
    return found


def _spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that begin in the ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: removed byte ranges (end exclusive) and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = payloads(batch.column("text"))
            spans = [_spans(r or [], length) for r in batch.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.array([[{"begin": a, "end": b} for a, b in row] for row in spans], spans_type),
                    pa.array([_kept(t, row) for t, row in zip(texts, spans)], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    ranges = repeated_ranges(docs, length, gram, keep_first).distinct()
    grouped = materialise(ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "grouped")
    n_ranges = grouped.agg(F.sum(F.size("ranges"))).first()[0] or 0
    side = F.broadcast(grouped) if n_ranges <= COPY_ROWS else grouped
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key("doc_id", "text"))
    rows = keyed.join(side, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def span_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, with every repeated string removed everywhere."""
    rows = remove_repeats(docs, length)
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
