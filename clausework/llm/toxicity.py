"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight vector serves all thresholds: ``P(grade > j) = sigmoid(w.x - t_j)`` with ``t_0 < t_1 < ...``; the expected
severity is the sum of these probabilities. The model is fitted on a bounded sample of labelled documents, whose
features are made in tasks; all documents are scored where they lie, with no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.common import WORD_CACHE, payloads

# bound of the labelled sample, half of it for either class: documents with the smallest hashes of their ids
SAMPLE_ROWS = 10_000
DIMENSIONS = 1 << 19
# a feature takes part if it is that much more frequent among toxic documents, in that many of them
LIFT = 2.0
SUPPORT = 3
# and marks toxicity, for grades, from here on
MARK_LIFT = 5.0
# strength of the quadratic penalty on the weights, against the mean loss
PENALTY = 1e-5
STEPS = 80
REJECT = 0.5

# texts of a batch that are held as bytes at a time
_AT_ONCE = 256

_TOKEN = re.compile(r"[^\W_]+")
# lengths of the word beginnings that count as features beside the whole word: insults are inflected
_BEGINNINGS = (3, 4, 5, 6, 7)


class _Places(dict):
    """The hashed features of a word: itself and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE // 2:
            self.clear()
        parts = [word, *("^" + word[:n] for n in _BEGINNINGS if n <= len(word))]
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(p) % DIMENSIONS for p in parts)
        return value


def features(text: bytes, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of the whole text in lower case, and ``1 + log(count)`` of each."""
    counts = Counter(_TOKEN.findall(text.decode(errors="replace").lower()))
    found = [places[word] for word in counts]
    at = np.fromiter(chain.from_iterable(found), np.int64)
    times = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), np.fromiter(map(len, found), np.int64, len(found)))
    distinct, where = np.unique(at, return_inverse=True)
    return distinct, 1 + np.log(np.bincount(where, times, len(distinct)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one per hashed word
    thresholds: np.ndarray  # increasing

    def above(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > j)`` per row and threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class _Rows:
    """Sparse rows with the two products that fitting needs, and a weight per row."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray], weights: np.ndarray):
        self.places, self.values = np.concatenate(places), np.concatenate(values)
        sizes = np.array([len(p) for p in places])
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(sizes)
        self.weights = weights / weights.sum()

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.places], self.n)

    def gather(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.places, self.values * r[self.row], size)


def _loss(rows: _Rows, grades: np.ndarray, levels: int, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted mean negative log likelihood with penalty, and its gradient. ``x``: weights, first threshold, log gaps."""
    size = len(x) - (levels - 1)
    w, first, gaps = x[:size], x[size], np.exp(x[size + 1 :])
    t = np.r_[-np.inf, first + np.r_[0, np.cumsum(gaps)], np.inf]
    score = rows.scores(w)
    low, high = _sigmoid(t[grades] - score), _sigmoid(t[grades + 1] - score)  # P(y < g), P(y <= g)
    p = np.maximum(high - low, 1e-12)
    d_low, d_high = low * (1 - low), high * (1 - high)
    share = rows.weights / p
    gradient = np.empty_like(x)
    gradient[:size] = rows.gather((d_high - d_low) * share, size) + PENALTY * w
    by_t = np.zeros(levels + 1)
    np.add.at(by_t, grades, d_low * share)
    np.add.at(by_t, grades + 1, -d_high * share)
    inner = by_t[1:levels]
    gradient[size] = inner.sum()
    gradient[size + 1 :] = [inner[k + 1 :].sum() * gaps[k] for k in range(levels - 2)]
    return float(-(rows.weights * np.log(p)).sum() + 0.5 * PENALTY * (w @ w)), gradient


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        step = 1.0 if pairs else 1.0 / max(np.abs(g).max(), 1e-12)
        while True:
            new = x - step * q
            new_value, new_g = f(new)
            if new_value <= value - 1e-4 * step * (g @ q) or step < 1e-8:
                break
            step /= 2
        s, y = new - x, new_g - g
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, g = new, new_value, new_g
        if done:
            break
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
    return x


def _lifts(toxic: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """How much more frequent a feature is among toxic documents; 0 for those in too few of them."""
    in_toxic, in_clean = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for label, p in zip(toxic, places):
        (in_toxic if label else in_clean)[p] += 1
    lift = (in_toxic + 0.5) / (toxic.sum() + 1) / ((in_clean + 0.5) / ((~toxic).sum() + 1))
    return np.where(in_toxic >= SUPPORT, lift, 0)


def _grades(toxic: np.ndarray, marks: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """0 for documents labelled clean; toxic ones 1, or 2 if their share of marking features is above the median of such."""
    share = np.array([marks[p].mean() if len(p) else 0.0 for p in places])
    return toxic * (1 + (share > np.median(share[toxic])))


def train(labels: np.ndarray, places: list[np.ndarray], values: list[np.ndarray], weights: np.ndarray) -> OrdinalModel:
    """The model of documents given as hashed features, with a label and a weight each."""
    toxic = labels > 0
    lift = _lifts(toxic, places)
    if labels.max() == 1:
        grades = _grades(toxic, lift >= MARK_LIFT, places)
    else:
        grades = np.unique(np.maximum(labels, 0), return_inverse=True)[1]
    levels = int(grades.max()) + 1
    chosen = np.flatnonzero(lift >= LIFT) if labels.max() == 1 else np.unique(np.concatenate(places))
    column = np.full(DIMENSIONS, -1)
    column[chosen] = np.arange(len(chosen))
    kept = [column[p] >= 0 for p in places]
    rows = _Rows([column[p[k]] for p, k in zip(places, kept)], [v[k] for v, k in zip(values, kept)], weights)
    start = np.r_[np.zeros(len(chosen)), 1.0, np.zeros(levels - 2)]
    x = _minimise(lambda at: _loss(rows, grades, levels, at), start, STEPS)
    full = np.zeros(DIMENSIONS, np.float32)
    full[chosen] = x[: len(chosen)]
    return OrdinalModel(full, x[len(chosen)] + np.r_[0, np.cumsum(np.exp(x[len(chosen) + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """A model from at most ``sample_rows`` labelled documents, half of them toxic; None if they are not of both kinds.

    ``labels.toxic`` above 1 is taken as a grade; with only 0 and 1 the toxic ones are split in two by how dense features are
    that mark toxicity. Rows weigh as their class is sampled, so chances are those of all labelled documents. Null labels
    and ids take no part; of labels that share an id the largest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    halves = [known.where(kind).orderBy(*by_hash).limit(sample_rows // 2) for kind in ("toxic > 0", "toxic <= 0")]
    chosen = halves[0].unionByName(halves[1])
    totals = known.agg(F.count_if(F.col("toxic") > 0), F.count("*")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        # features take many times the text: a slice of a batch at a time
        for batch in (b.slice(lo, _AT_ONCE) for b in batches for lo in range(0, b.num_rows, _AT_ONCE)):
            rows = [features(t, places) for t in payloads(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.array([p.astype(np.int32).tobytes() for p, _ in rows], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary()),
                ],
                names=["doc_id", "toxic", "places", "features"],
            )

    # at most ``sample_rows`` ids and labels are copied to the tasks
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))), "doc_id"
    )
    table = texts.mapInArrow(run, "doc_id long, toxic int, places binary, features binary").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("places", "ascending")])
    labels_of = table["toxic"].to_numpy()
    if not len(labels_of) or labels_of.min() > 0 or labels_of.max() < 1:
        return None
    places = [np.frombuffer(p, np.int32) for p in table["places"].to_pylist()]
    values = [np.frombuffer(v, np.float32) for v in table["features"].to_pylist()]
    toxic = labels_of > 0
    weights = np.where(toxic, totals[0] / toxic.sum(), (totals[1] - totals[0]) / (~toxic).sum())
    return train(labels_of, places, values, weights)


def score(texts: pa.Array, model: OrdinalModel | None, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Severity and chance of any grade above 0 of every text; one text's features are held at a time, a batch's would take
    many times its texts."""
    if model is None:
        return np.zeros(len(texts)), np.zeros(len(texts))
    sums, worded = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for lo in range(0, len(texts), _AT_ONCE):
        for i, text in enumerate(payloads(texts.slice(lo, _AT_ONCE)), lo):
            p, v = features(text, places)
            sums[i], worded[i] = model.weights[p] @ v, len(p) > 0
    above = model.above(sums)
    return np.where(worded, above.sum(axis=1), 0), np.where(worded, above[:, 0], 0)


def _scored(docs: DataFrame, model: OrdinalModel | None, carried: list) -> DataFrame:
    """The carried columns with ``severity, p_toxic``; both 0 without a model and for texts without words."""
    rows = docs.select(*carried, "text")
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in batches:
            severity, p_toxic = score(batch.column("text"), model, places)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(severity, pa.float64()), pa.array(p_toxic, pa.float64())],
                names=[*names, "severity", "p_toxic"],
            )

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, reject: float = REJECT) -> DataFrame:
    """``doc_id, severity, p_toxic, rejected`` of every row: the expected grade and the chance of any grade above 0.

    Null and empty texts have severity 0; so has every text if the labels hold no model. Null ids and repeated rows are
    scored like any other; a null id has no label. Texts are read whole. Other columns, whatever their names, play no part.
    """
    scored = _scored(docs, fit(docs, labels, sample_rows), [F.col("doc_id").cast("long").alias("doc_id")])
    return scored.withColumn("rejected", F.col("p_toxic") >= reject)


def clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, reject: float = REJECT) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` rejects. Only texts go to the Python workers, only chances come back."""
    model = fit(docs, labels, sample_rows)

    @F.arrow_udf("double")
    def chance(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Places()
        for texts in batches:
            yield pa.array(score(texts, model, places)[1], pa.float64())

    return docs.where(chance("text") < reject)
