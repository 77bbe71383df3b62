"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, toxic or not, are unlabelled. A linear numpy classifier over
hashed words minimises pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)), pi being the share of toxic rows among the labelled
ones: the negative risk of unlabelled texts is corrected for the toxic ones among them and never let below zero.
Labelled rows kept out of that fit then map its output to a chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import remainder, text_batches, written
from .words import NOT_WORD, binary, chunks, word_hashes, words

#: Bits of a word's place among the weights.
DIM_BITS = 19
#: The classifier is fitted on so many rows at most: confirmed toxic, unlabelled, labelled for the calibration.
MAX_POSITIVE, MAX_UNLABELLED, MAX_CALIBRATION = 4_000, 10_000, 4_000
#: Bytes of the beginnings of longer words, which stand for their derived forms.
BEGINNINGS = (4, 6)
#: A word counts only if so many of the sampled texts have it.
LEAST_TEXTS = 4
#: Features of a sampled text that the fit reads, at most: those with the lowest places, which are hashes. Scoring reads all.
MAX_FEATURES = 2_048


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def features(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and word beginnings of each row as places of weights, their values, and how many each row has. A value is the damped
    logarithm of the word's count; it isn't scaled by the text's length, so a few words weigh as much in a long text."""
    starts, ends, many = words(text, offsets, NOT_WORD)
    row = np.repeat(np.arange(len(many)), many)
    hashes, rows = [word_hashes(text, starts, ends)], [row]
    for n in BEGINNINGS:
        longer = ends - starts > n
        hashes.append(~word_hashes(text, starts[longer], starts[longer] + n))
        rows.append(row[longer])
    place = (np.concatenate(hashes) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
    row = np.concatenate(rows)
    key, count = np.unique((row << DIM_BITS) | place, return_counts=True)
    value = 1 + 0.5 * np.log(count)
    return (key & ((1 << DIM_BITS) - 1)).astype(np.int32), value.astype(np.float32), np.bincount(key >> DIM_BITS, minlength=len(many))


def row_sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(many)), many), values, len(many))


class Rows:
    """Sparse rows, of which a few are taken at a time."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray]):
        self.many = np.array([len(x) for x in places], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.places = np.concatenate([*places, np.empty(0, np.int32)])
        self.values = np.concatenate([*values, np.empty(0, np.float32)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = self.many[rows]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[rows], many)
        return self.places[at], self.values[at], many


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """How the loss to be lowered changes with the margins of positive and unlabelled rows: the risk's slopes, or, where the
    corrected risk of negatives has gone below zero, those of its return along it."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        return prior * (sp - 1) / len(sp) - prior * sp / len(sp), su / len(su)
    return prior * sp / len(sp), -su / len(su)


def fit_nnpu(positive: Rows, unlabelled: Rows, prior: float, steps: int = 2000, rate: float = 0.1, shrink: float = 6e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk with logistic loss, by AdaGrad over small batches; each step also
    shrinks the weights towards zero, so that words which tell nothing keep no weight."""
    rng = np.random.default_rng(seed)
    dim = 1 << DIM_BITS
    texts = np.bincount(np.concatenate([positive.places, unlabelled.places]), minlength=dim)
    active = np.flatnonzero(texts >= LEAST_TEXTS)
    to = np.full(dim, len(active), np.int64)
    to[active] = np.arange(len(active))
    w, b = np.zeros(len(active) + 1), 0.0
    square = np.full(len(w) + 1, 1e-6)
    for step in range(1, steps + 1):
        p = positive.take(rng.integers(0, len(positive.many), min(64, len(positive.many))))
        u = unlabelled.take(rng.integers(0, len(unlabelled.many), min(256, len(unlabelled.many))))
        p, u = (to[p[0]], p[1], p[2]), (to[u[0]], u[1], u[2])
        zp, zu = row_sums(w[p[0]] * p[1], p[2]) + b, row_sums(w[u[0]] * u[1], u[2]) + b
        gp, gu = slopes(zp, zu, prior)
        grad = np.bincount(p[0], np.repeat(gp, p[2]) * p[1], len(w)) + np.bincount(u[0], np.repeat(gu, u[2]) * u[1], len(w))
        grad = np.append(grad, gp.sum() + gu.sum())
        square += grad**2
        pace = rate / np.sqrt(square)
        w, b = w - pace[:-1] * grad[:-1], b - pace[-1] * grad[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - shrink * pace[:-1])
        w[-1] = 0.0
    weights = np.zeros(dim, np.float32)
    weights[active] = w[:-1]
    return weights, float(b)


def calibrate(margin: np.ndarray, toxic: np.ndarray, threshold: float = 0.7) -> tuple[float, float]:
    """Slope and shift of a logistic map from margins to chances; the plain map if one class is missing.

    The slope is that of a fit with softened targets; the shift puts `threshold` at the margin with the best F1 score.
    """
    n1, n0 = toxic.sum(), (~toxic).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])), -2, 2)
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(toxic[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(order) + 1) + n1)))
    lowest = margin[order[best]]
    below = margin[order[best + 1]] if best + 1 < len(order) else lowest - 1
    cut = (lowest + below) / 2
    slope = max(float(theta[0]), 1e-3)
    return slope, float(np.log(threshold / (1 - threshold)) - slope * cut)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled rows among `labels` (doc_id, toxic) and a bounded sample of `docs`; None without a
    confirmed toxic text. A document labelled more than once is toxic if any of its labels says so; rows equal in id and text
    teach once. The sample is written, and the fit is one task over it."""
    text_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    total = docs.count()
    if not counts[1] or not total:
        return None
    prior = (counts[1] + 0.5) / (counts[0] + 1)
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keeps = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    first = lambda df, n: df.orderBy(by_id, "doc_id").limit(n)
    chosen = first(known.where((F.col("toxic") == 1) & ~keeps), MAX_POSITIVE).unionByName(first(known.where(keeps), MAX_CALIBRATION)).select(F.col("doc_id").alias("of"), F.when(keeps, F.when(F.col("toxic") == 1, 1).otherwise(0)).otherwise(2).alias("kind"))
    lot = F.xxhash64("doc_id", "text")
    share = int(min(1.0, 1.2 * MAX_UNLABELLED / total) * (1 << 30))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"), "left").where(F.col("kind").isNotNull() | (F.pmod(lot, F.lit(1 << 30)) < share))
    rows = found.select(F.coalesce("kind", F.lit(3)).alias("kind"), lot.alias("lot"), F.col("text").cast("binary").alias("text")).dropDuplicates(["kind", "lot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = binary(batch.column(2))
            for a, b in chunks(offsets):
                places, values, many = features(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                nth = np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many)  # the places of a row rise
                places, values = places[nth < MAX_FEATURES], values[nth < MAX_FEATURES]
                cuts = pa.array(np.append(0, np.cumsum(np.minimum(many, MAX_FEATURES))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.ListArray.from_arrays(cuts, pa.array(places)), pa.ListArray.from_arrays(cuts, pa.array(values))], names=["kind", "lot", "places", "values"])

    sample = written(rows.mapInArrow(run, "kind int, lot long, places array<int>, values array<float>"))
    some = lambda test, n: sample.where(test).orderBy("lot").limit(n)
    bounded = some("kind = 2", MAX_POSITIVE).unionByName(some("kind = 3", MAX_UNLABELLED)).unionByName(some("kind < 2", MAX_CALIBRATION)).drop("lot")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"kinds": [], "places": [], "values": []}
        for batch in batches:
            held["kinds"] += batch.column(0).to_pylist()
            held["places"] += [np.asarray(x.values, np.int32) for x in batch.column(1)]
            held["values"] += [np.asarray(x.values, np.float32) for x in batch.column(2)]
        kinds = np.array(held["kinds"], int)
        pick = lambda which: Rows([x for x, k in zip(held["places"], kinds) if k in which], [x for x, k in zip(held["values"], kinds) if k in which])
        positive, unlabelled, kept = pick({2}), pick({2, 3}), pick({0, 1})
        if not len(positive.many):
            return
        weights, bias = fit_nnpu(positive, unlabelled, prior)
        slope, shift = calibrate(row_sums(weights[kept.places] * kept.values, kept.many) + bias, kinds[kinds < 2] == 1)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (bias, slope, shift))], names=["weights", "bias", "slope", "shift"])

    got = bounded.repartition(1).mapInArrow(fit, "weights binary, bias double, slope double, shift double").collect()  # a row at most
    return Model(np.frombuffer(got[0].weights, np.float32), got[0].bias, got[0].slope, got[0].shift) if got else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The documents' columns but text, with toxicity (0 to 1, higher: likelier toxic) and is_toxic (at the threshold).
    Null and empty texts have the score of a text without words; without a model every score is 0. Columns named toxicity or
    is_toxic are replaced."""
    text_batches(docs.sparkSession)
    docs = docs.drop("toxicity", "is_toxic")
    if model is None:
        return docs.drop("text").withColumns({"toxicity": F.lit(0.0), "is_toxic": F.lit(False)})
    held = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = binary(batch.column(len(others)))
            margins = [np.empty(0)]
            for a, b in chunks(offsets):
                places, values, many = features(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                margins.append(row_sums(held.value.weights[places] * values, many) + held.value.bias)
            chance = held.value.chance(np.concatenate(margins))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(chance), pa.array(chance >= threshold)], names=[*others, "toxicity", "is_toxic"])

    schema = docs.select(*others).schema.add("toxicity", "double").add("is_toxic", "boolean")
    return docs.select(*others, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they were, whatever their names.

    Null and empty texts are scored as texts without words; repeated rows are scored, and stay or go, each; without a
    confirmed toxic text all stay; an empty table gives an empty result.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    return score(docs.select(F.struct("*").alias("whole_row"), "text"), model, threshold).where(~F.col("is_toxic")).select("whole_row.*")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; only rows outside the held-out third teach.

    A null doc_id counts as the empty text for the fold. Repeated rows are scored each; columns beside doc_id and text
    are never read; empty tables give an empty result.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out).select("doc_id", "text"), labels.where(~held_out))
    return score(docs.select("doc_id", "text"), model, threshold).select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted"))
