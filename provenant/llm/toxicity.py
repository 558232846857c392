"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled text are learned from. With prior p of toxic text among the
unlabelled, the risk of a classifier g is estimated as

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

(Kiryo et al., 2017); the second part, the risk on clean text, cannot be negative, and a step that finds it so
goes back instead (its gradient with the sign turned). Spark finds the features, builds the examples and scores
the corpus; numpy fits a few linear classifiers on bounded samples, whose mean is the score.

Features of a text are the words in it and the words' first 3 to 6 bytes, each once however often it occurs,
A-Z lower-cased; everything in ASCII but letters and digits separates words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.shared import Words, free_name, hold, pieces, with_field

#: Bounds of the sample that the classifiers are fitted on, in texts.
POSITIVE, UNLABELLED = 8_000, 12_000
FEATURES = 512
#: Standard errors by which a feature must be more frequent in toxic texts; below, chance alone makes as many.
LEAST_Z = 5.0
#: Prior of toxic text where labels don't tell it.
PRIOR = 0.1
THRESHOLD = 0.7
_FILTER = 1 << 16

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = True
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Model:
    """Sorted 64-bit feature values, with a weight for each classifier (rows) and feature (columns), and their biases."""

    features: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def scores(self, batch: pa.RecordBatch, text: str = "text") -> np.ndarray:
        out = []
        for part in pieces(batch, text):
            doc, column = lookup(part.column(text), self.features)
            g = np.zeros((len(self.biases), part.num_rows))
            for k, w in enumerate(self.weights):
                g[k] = np.bincount(doc, weights=w[column], minlength=part.num_rows) + self.biases[k]
            out.append(1 / (1 + np.exp(-np.clip(g.mean(axis=0), -60, 60))))
        return np.concatenate(out) if out else np.zeros(0)


def feature_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of all features, with repeats."""
    w = Words(texts, separators=_SEPARATORS)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    docs, values = [owner], [w.values()]
    for k in (3, 4, 5, 6):
        longer = np.flatnonzero(w.end - w.start > k)
        docs.append(owner[longer])
        values.append(w.beginnings(longer, k))
    return np.concatenate(docs), np.concatenate(values)


def lookup(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of those features that a model has, each once for a text."""
    doc, value = feature_values(texts)
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    may = np.zeros(_FILTER, bool)
    may[(features & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    hit = may[(value & np.uint64(_FILTER - 1)).astype(np.int64)]
    doc, value = doc[hit], value[hit]
    at = np.minimum(np.searchsorted(features, value), len(features) - 1)
    hit = features[at] == value
    both = np.unique(doc[hit] * len(features) + at[hit])
    return both // len(features), both % len(features)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, positive texts, unlabelled texts), added up over each piece of the sample."""
    for batch in batches:
        for part in pieces(batch, "text"):
            doc, value = feature_values(part.column("text"))
            values, inverse = np.unique(value, return_inverse=True)
            pairs = np.unique(doc * len(values) + inverse) if len(values) else np.zeros(0, np.int64)
            positive = part.column("positive").to_numpy(zero_copy_only=False)[pairs // max(len(values), 1)]
            column = pairs % max(len(values), 1)
            counts = [np.bincount(column[positive == flag], minlength=len(values)) for flag in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts[0]), pa.array(counts[1])], ["feature", "pos", "unl"])


def _examples(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, column = lookup(part.column("text"), features)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                rows = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(column.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), rows], ["doc_id", "positive", "columns"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def nnpu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear classifier g by the non-negative risk estimate with the sigmoid loss; rows of both are 0/1 features."""
    w, b = np.zeros(pos.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (pos, unl))
        # the derivative of l(-g) = sigmoid(g) is s (1 - s), that of l(g) its negative
        up, uu = prior * sp * (1 - sp) / len(pos), su * (1 - su) / len(unl)
        if su.mean() >= prior * sp.mean():
            dp, du = -2 * up, uu
        else:
            dp, du = up, -uu
        grad = np.append(dp @ pos + du @ unl + decay * w, dp.sum() + du.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return w, float(b)


def best_cut(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """Where to cut g: the middle of the cuts with the least risk, by rows that were not fitted on.

    The risk is the same estimate, with errors counted and those on clean text doubled.
    """
    cuts = np.linspace(min(pos.min(), unl.min()), max(pos.max(), unl.max()), 401)
    missed = np.searchsorted(np.sort(pos), cuts) / len(pos)
    taken = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    risk = prior * missed + 2 * np.maximum(0, taken - prior * (1 - missed))
    return float(np.median(cuts[risk <= risk.min() + 1e-9]))


def ensemble(pos: np.ndarray, unl: np.ndarray, prior: float, classifiers: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of classifiers that were fitted on three quarters of the rows each; together they are
    shifted so that the best cut of their left-out rows scores ``THRESHOLD``."""
    weights, biases, left = [], [], ([], [])
    for seed in range(classifiers):
        rng = np.random.default_rng(seed)
        cut = [(order[: max(1, len(x) * 3 // 4)], order[len(x) * 3 // 4 :]) for x in (pos, unl) for order in [rng.permutation(len(x))]]
        w, b = nnpu_fit(pos[cut[0][0]], unl[cut[1][0]], prior)
        weights.append(w)
        biases.append(b)
        for rows, x, (_, rest) in zip(left, (pos, unl), cut, strict=True):
            rows.append(x[rest] @ w + b)
    at = best_cut(np.concatenate(left[0]), np.concatenate(left[1]), prior)
    return np.array(weights, np.float64), np.array(biases) - at + np.log(THRESHOLD / (1 - THRESHOLD))


def fit(docs: DataFrame, labels: DataFrame, classifiers: int = 3) -> Model:
    """Classifiers from the toxic rows of ``labels`` (doc_id, toxic) and unlabelled rows of ``docs``.

    Rows of ``held_out`` are left aside. At most ``POSITIVE`` confirmed toxic texts and ``UNLABELLED`` texts of
    any kind, those with the smallest hashes, are learned from; of rows that share a doc_id the one with the least
    text. The prior is the share of toxic rows among the labelled ones; an id is toxic if any of its labels says so.
    Null ids and labels teach nothing. Without a confirmed toxic text nothing can be learned: every score is the
    prior.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out())
    labels = labels.groupBy("doc_id").agg(F.max(F.expr("cast(toxic as int)")).alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out())
    order = F.expr("xxhash64(doc_id, 4)")
    positive = ids.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").distinct().orderBy(order, "doc_id").limit(POSITIVE)
    unlabelled = ids.distinct().orderBy(order, "doc_id").limit(UNLABELLED)
    chosen = hold(positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))), "op4-chosen")
    share = labels.agg(F.avg("toxic")).first()[0]
    prior = share if share and share < 0.9 else PRIOR

    # at most POSITIVE + UNLABELLED ids: safe to broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    # one text for each id, so that the sample is bounded whatever repeats
    sample = hold(sample.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id"), "op4-sample")
    n_pos, n_unl = (sample.filter(c).count() for c in ("positive", "not positive"))
    flat = Model(np.zeros(0, np.uint64), np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]))
    if not n_pos or not n_unl:
        return flat

    counts = sample.mapInArrow(_document_counts, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    p, u = F.col("pos") / n_pos, F.col("unl") / n_unl
    base = (F.col("pos") + F.col("unl") + 1) / (n_pos + n_unl + 2)
    # the words that toxic texts have more often than others do
    counts = counts.filter(F.col("pos") + F.col("unl") >= 8).select("feature", ((p - u) / F.sqrt(base * (1 - base) * (1 / n_pos + 1 / n_unl))).alias("z"))
    top = counts.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    features = np.sort(np.array([r.feature for r in top], np.int64).view(np.uint64))
    if not len(features):
        return flat
    rows = sample.mapInArrow(_examples(features), "doc_id long, positive boolean, columns array<int>").toArrow()
    flags = rows.column("positive").to_numpy()
    lists = rows.column("columns").combine_chunks()
    dense = np.zeros((len(flags), len(features)), np.float32)
    dense[np.repeat(np.arange(len(flags)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    # rows in the order of their ids, so that reruns fit the same classifiers
    order = np.lexsort((rows.column("doc_id").to_numpy(), ~flags))
    dense, flags = dense[order], flags[order]
    return Model(features, *ensemble(dense[flags], dense[~flags], prior, classifiers))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row's whole text; null and empty texts score as texts without features.

    A column that has the new one's name is replaced.
    """
    docs = docs.drop(to)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch, text), pa.float64())], schema=pa.schema([*batch.schema, pa.field(to, pa.float64())]))

    return docs.mapInArrow(run, with_field(docs, to, "double"))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text); texts stay where they are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, repeated rows included.

    Null and empty texts have no features and get the score of such a text. A null doc_id is never held out.
    An empty table gives no rows; without labels every score is the prior and nothing is predicted.
    """
    return scores(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic.

    Other columns are kept as they are, whatever their names. Null and empty texts, and rows without a doc_id, stay
    unless a text without features scores as toxic; equal texts share their fate; an empty table stays empty.
    """
    own = free_name(docs, "_toxicity")
    return score(docs, fit(docs, labels), to=own).filter(F.col(own) < THRESHOLD).drop(own)
