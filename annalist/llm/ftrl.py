"""Logistic regression over hashed n-grams, trained by follow the regularised leader.

FTRL-proximal keeps, for each coordinate, the sum of its adjusted gradients and
of their squares. The weight is found from both in closed form: its learning
rate falls with the coordinate's own history, and a coordinate whose sum stays
within the L1 bound has weight exactly 0, so few weights are left.

The labelled sample is bounded. It may be dealt to several shards, which train
by themselves; their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.ngrams import Grams, features


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents that training reads; ``shards`` are the
    tasks that train side by side. ``presence``: a gram counts once per
    document; else by its share of the document's grams, times ``scale``. Grams
    of fewer than ``least_docs`` documents of a shard are not trained."""

    grams: Grams
    presence: bool
    scale: float = 1.0
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1
    epochs: int = 3
    least_docs: int = 3
    sample: int = 12_000
    shards: int = 1


@dataclass(frozen=True)
class Model:
    """The non-zero weights: at most 2**bits, far fewer by L1."""

    settings: Settings
    codes: np.ndarray
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Sparse:
    """Sparse vectors one after another: vector k is ``ends[k] : ends[k + 1]``."""

    codes: np.ndarray
    values: np.ndarray
    ends: np.ndarray


def vectors(texts: pa.Array, settings: Settings) -> Sparse:
    """The sparse vectors of an array of texts, in its order."""
    codes, values, sizes = [np.empty(0, np.int32)], [np.empty(0, np.float32)], [np.empty(0, np.int64)]
    for found, docs, rows in features(texts, settings.grams):
        total = np.bincount(docs, minlength=len(rows))
        both, count = np.unique((docs.astype(np.int64) << 32) | found, return_counts=True)
        doc = both >> 32
        codes.append((both & 0xFFFFFFFF).astype(np.int32))
        values.append((np.ones(len(both)) if settings.presence else settings.scale * count / np.maximum(total[doc], 1)).astype(np.float32))
        sizes.append(np.bincount(doc, minlength=len(rows)))
    return Sparse(np.concatenate(codes), np.concatenate(values), np.r_[0, np.cumsum(np.concatenate(sizes))])


def fit_shard(examples: Sparse, labels: np.ndarray, settings: Settings, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(codes, weights, bias) after ``epochs`` passes in a shuffled order. The
    bias is a coordinate of its own, without L1."""
    often = np.bincount(examples.codes, minlength=1 << settings.grams.bits) >= settings.least_docs
    used = np.flatnonzero(often)
    kept = often[examples.codes]
    own, values = np.searchsorted(used, examples.codes[kept]), examples.values[kept].astype(np.float64)
    ends = np.r_[0, np.cumsum(kept)][examples.ends]
    alpha, beta, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2
    z, n, bias_z, bias_n = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0

    def weight(of_z: np.ndarray, of_n: np.ndarray) -> np.ndarray:
        return -np.sign(of_z) * np.maximum(np.abs(of_z) - l1, 0.0) / ((beta + np.sqrt(of_n)) / alpha + l2)

    def bias() -> float:
        return -bias_z / ((beta + bias_n**0.5) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(labels)):
            at, x = own[ends[k] : ends[k + 1]], values[ends[k] : ends[k + 1]]
            was_z, was_n = z[at], n[at]
            w = weight(was_z, was_n)
            raw, b = float(w @ x), bias()
            error = 1 / (1 + np.exp(-min(max(raw + b, -35.0), 35.0))) - labels[k]
            gradient = error * x
            new_n = was_n + gradient * gradient
            n[at] = new_n
            z[at] = was_z + gradient - (np.sqrt(new_n) - np.sqrt(was_n)) / alpha * w
            bias_z += error - ((bias_n + error * error) ** 0.5 - bias_n**0.5) / alpha * b
            bias_n += error * error
    final = weight(z, n)
    kept_codes = np.flatnonzero(final)
    return used[kept_codes], final[kept_codes], float(bias())


def fit(docs: DataFrame, labels: DataFrame, label: str, identity: str, text: str, settings: Settings, seed: int = 5) -> Model:
    """Train on at most ``settings.sample`` of the labelled documents, those
    with the least hash of the identity.

    ``labels`` (identity, label 0 or 1): null identities and null labels are
    left out; a document labelled several times counts once, as 1 if any label
    is 1; labels without a document are unused; of documents with the same
    identity one is used. Without any labelled document all scores are 0.5.
    """
    named = labels.where(F.col(identity).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(identity).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    chosen = named.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(settings.sample)
    shown = docs.select(F.col(identity).alias("__id"), F.col(text).cast("string").alias("__text"))
    # the chosen ones are bounded by the parameter, so their broadcast is too
    examples = shown.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if len(b)]
        if not tables:
            return
        table = pa.Table.from_batches(tables).sort_by("__id")
        kept, weights, bias = fit_shard(vectors(table["__text"].combine_chunks(), settings), table["__label"].to_numpy(), settings, seed)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(weights, bias), pa.float64())], names=["code", "weight"])

    dealt = examples.select("__id", "__text", "__label").repartition(settings.shards, F.xxhash64("__id"))
    parts = dealt.mapInArrow(train, "code long, weight double").groupBy("code").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("shards"))
    rows = parts.collect()  # at most 2**bits + 1 numbers
    trained = max((r["shards"] for r in rows if r["code"] == -1), default=1)
    bias = sum(r["weight"] for r in rows if r["code"] == -1) / trained
    kept = sorted((r["code"], r["weight"] / trained) for r in rows if r["code"] >= 0)
    return Model(settings, np.array([k for k, _ in kept], np.int64), np.array([w for _, w in kept], np.float64), bias)


def score_texts(texts: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text, as sparse dot products."""
    scores = np.empty(len(texts))
    settings = model.settings
    for codes, docs, rows in features(texts, settings.grams):
        weight = dense[codes]
        used = weight != 0
        if settings.presence:
            both, first = np.unique((docs[used].astype(np.int64) << 32) | codes[used], return_index=True)
            total = np.bincount(both >> 32, weights=weight[used][first], minlength=len(rows))
        else:
            size = np.bincount(docs, minlength=len(rows))
            total = settings.scale * np.bincount(docs[used], weights=weight[used], minlength=len(rows)) / np.maximum(size, 1)
        scores[rows] = 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))
    return scores


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column of scores for ``docs``. The sparse weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batch: pa.Array) -> pa.Array:
        held = shared.value
        dense = np.zeros(1 << held.settings.grams.bits, np.float32)
        dense[held.codes] = held.weights
        return pa.array(score_texts(batch, held, dense), pa.float64())

    return scored(text.cast("string"))
