"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and documents whose label is not looked at (U) train a linear classifier in numpy.
With class prior pi and logistic loss the risk is ``pi R+(P) + max(0, R-(U) - pi R-(P))``: the unlabelled
text stands in for the clean class, corrected by the share of toxic text in it, and where the corrected part turns
negative its gradient is turned round, so that the classifier can't gain by overfitting it. Features are the words
of a document and their first letters, present or not, so long documents count as short ones do.
Only a bounded sample is used to fit (``MOST_POSITIVE``, ``MOST_UNLABELLED`` documents); every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.session import cut

#: The largest samples that a fit uses.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
#: Hashed features; a document has at most this many.
BITS = 18
#: A feature gets a weight if so many positive documents have it, and its share among them is so many standard errors above
#: its share in the unlabelled text and so many times as large (less if toxic text is common).
LEAST, ERRORS, LIFT = 4, 5.0, 3.0
STEPS, RATE, DECAY = 120, 0.1, 1e-4
#: How far below zero the corrected risk may fall, in priors, before its gradient is turned round.
SLACK = 0.2
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
MEMO = 200_000


def word_features(word: str) -> list[int]:
    """The word itself and its first 4, 5 and 6 letters, hashed."""
    kinds = {"=" + word} | {f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k}
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in kinds]


def present(text: str | None, memo: dict[str, list[int]]) -> np.ndarray:
    """Sorted features of a text."""
    got: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        f = memo.get(w)
        if f is None:
            if len(memo) >= MEMO:
                memo.clear()
            f = memo[w] = word_features(w)
        got.update(f)
    return np.array(sorted(got), np.int32)


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, table: dict[int, float], found: set[int]) -> float:
        z = self.bias + sum(table[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def choose(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """The features that get a weight, from how many positive and unlabelled documents have each."""
    n_p, n_u = max(1, n_p), max(1, n_u)
    both = (in_p + in_u) / (n_p + n_u)
    above = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    lift = (in_p / n_p) >= min(LIFT, 0.5 / prior) * in_u / n_u
    return np.flatnonzero((in_p >= LEAST) & (above >= ERRORS) & lift)


def clipped(prior: float) -> float:
    return float(np.clip(prior, 1e-3, 0.5))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Choose features and train on the features of each document of the sample."""
    in_p, in_u = (np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=1 << BITS) for rows in (positive, unlabelled))
    feature = choose(in_p, in_u, len(positive), len(unlabelled), clipped(prior))
    return descend(positive, unlabelled, clipped(prior), feature)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The toxic and the corrected clean part of the risk, from the margins of positive and unlabelled documents."""
    soft = lambda z: np.logaddexp(0, z)
    return prior * soft(-zp).mean(), soft(zu).mean() - prior * soft(zp).mean()


def descend(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, feature: np.ndarray) -> Model:
    """Adam on the non-negative risk over the whole sample, features other than ``feature`` left out. No positive
    document: no weights, and the prior as score."""
    bias = float(np.log(prior / (1 - prior)))
    if not len(feature) or not unlabelled:
        return Model(np.empty(0, np.int64), np.empty(0), bias)
    index = np.full(1 << BITS, -1)
    index[feature] = np.arange(len(feature))

    def sparse(rows):
        kept = [index[r][index[r] >= 0] for r in rows]
        return np.concatenate(kept), np.repeat(np.arange(len(rows)), [len(k) for k in kept]), len(rows)

    p, u = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(len(feature)), bias
    m, v = np.zeros(len(feature) + 1), np.zeros(len(feature) + 1)
    for step in range(1, STEPS + 1):
        g = gradient(w, b, p, u, prior)
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    big = np.abs(w) > 1e-3
    return Model(feature[big], w[big], float(b))


def gradient(w: np.ndarray, b: float, p: tuple, u: tuple, prior: float) -> np.ndarray:
    """Of the risk by weights and bias; of the clean part turned round where that fell further below zero than allowed.
    ``p`` and ``u`` are (feature, document, documents) of each set's entries."""
    margins = lambda x: np.bincount(x[1], w[x[0]], x[2]) + b
    back = lambda x, g: np.append(np.bincount(x[0], g[x[1]], len(w)), g.sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    zp, zu = margins(p), margins(u)
    _, clean = risk(zp, zu, prior)
    g_clean = back(u, sigmoid(zu) / u[2]) - prior * back(p, sigmoid(zp) / p[2])
    g_toxic = prior * back(p, -sigmoid(-zp) / p[2])
    return g_toxic + g_clean if clean >= -SLACK * prior else -g_clean


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most so many distinct ids, by hash; a top-k in each task and one merge."""
    return ids.where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _features(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, f) with the features of each sampled document, written; of rows that repeat an id the one whose features
    come first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for b in batches:
            got = [present(t, memo) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "f"])

    # The ids number MOST_POSITIVE or MOST_UNLABELLED at most.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, f array<int>")
    return cut(rows.groupBy("doc_id").agg(F.min("f").alias("f")))


def _counts(rows: DataFrame) -> np.ndarray:
    """How many documents have each feature, added up by Spark; ``1 << BITS`` numbers at most come back."""
    t = rows.select(F.explode("f").alias("x")).groupBy("x").count().toArrow()
    return np.bincount(np.asarray(t["x"]), np.asarray(t["count"]), 1 << BITS).astype(np.int64)


def _chosen(rows: DataFrame, feature: np.ndarray) -> list[np.ndarray]:
    """Of each sampled document the features that get a weight; few of its features do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.intersect1d(np.array(f, np.int32), feature).astype(np.int32) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "f"])

    t = rows.mapInArrow(run, "doc_id long, f array<int>").orderBy("doc_id").toArrow()
    return [np.array(f, np.int32) for f in t["f"].to_pylist()]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic) that may be learnt from.

    The prior is the share of toxic ones among the labels less one standard error, as too large a prior
    would correct clean text away. Null labels and ids are ignored; an id with two
    labels counts as toxic if one says so. Features are counted by Spark over the sample, and only those that get a
    weight come to the driver."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = marks.agg(F.avg(F.col("toxic").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    share = told["p"] - (told["p"] * (1 - told["p"]) / told["n"]) ** 0.5 if told["n"] else 0.0
    positive = _features(docs, _sampled(marks.where("toxic = 1").select("doc_id"), MOST_POSITIVE))
    pool = docs.where(~held_out(F.col("doc_id"))).select("doc_id")
    unlabelled = _features(docs, _sampled(pool, MOST_UNLABELLED))
    feature = choose(_counts(positive), _counts(unlabelled), positive.count(), unlabelled.count(), clipped(share))
    return descend(_chosen(positive, feature), _chosen(unlabelled, feature), clipped(share), feature)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``THRESHOLD`` on) from the text alone; a null or empty text gets the
    score of no evidence. Own columns of these names give way."""
    docs = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
        memo: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                found: set[int] = set()
                for w in set(WORD.findall((text or "").lower())):
                    f = memo.get(w)
                    if f is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        f = memo[w] = [x for x in word_features(w) if x in table]
                    found.update(f)
                out.append(model.score(table, found))
            own = [pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
