"""Toxicity by logistic regression with the FTRL-proximal update over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their stems (first 4 to 7 bytes, for
inflected forms), of pairs of neighbours and of pairs with one or two words between them, plus a
constant. Training visits the sampled documents one by one in a fixed
order; each weight has its own learning rate, and the L1 term leaves nearly all weights at exactly
zero, so the model that tasks receive is a short list of pairs (bucket, weight).

Edge cases: a null or empty text has the constant alone and is scored by it. Without labelled rows
of both kinds the model has no weights and scores every text by the smoothed share of label 1.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import fitted, frugal, held_out, labelled_sample, pieces
from tidemark.llm.words import grams, stem_hashes

SHAPES = ((0,), (0, 1), (0, 2), (0, 3))  # word, pair, pairs over one and two words
STEMS = (4, 5, 6, 7)
BITS = 20
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 32_768
EPOCHS = 4
FEATURES_AT_ONCE = 256
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.7
PIECE_BYTES = 1 << 20  # of texts that are scored at once; a byte of text takes some 40 of features


@dataclass(frozen=True)
class Model:
    """Non-zero weights by bucket, ascending, and the weight of the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    constant: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.buckets] = self.weights
        return table


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each shape: buckets, the words they begin at, and the bounds of texts in words."""
    (hashes, *stems), bounds = stem_hashes(texts, (None, *STEMS))
    parts = [(hashes, shape) for shape in SHAPES] + [(stem, (0,)) for stem in stems]
    for k, (part, shape) in enumerate(parts):
        found, at = grams(part, bounds, shape, k)
        yield (found >> np.uint64(64 - BITS)).astype(np.int64), at, bounds


def _document_features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    owners, buckets = [], []
    for found, at, bounds in features(texts):
        buckets.append(found)
        owners.append(np.searchsorted(bounds, at, "right") - 1)
    keys = np.unique(np.concatenate(owners) << BITS | np.concatenate(buckets))
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    return [(keys[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """The model of the given texts; see `train` for the sample it gets. Their features wait in a temporary file."""
    none = np.empty(0, np.int64), np.empty(0, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(*none, float(np.log(share / (1 - share))))
    with tempfile.TemporaryFile() as kept:
        bounds = [0]
        for start in range(0, len(texts), FEATURES_AT_ONCE):
            for found in _document_features(texts.slice(start, FEATURES_AT_ONCE)):
                kept.write(found)
                bounds.append(bounds[-1] + len(found))
        kept.flush()
        buckets = np.memmap(kept, np.int32, "r").view(np.ndarray) if bounds[-1] else np.empty(0, np.int32)
        return _fit_rows(buckets, bounds, labels)


def _fit_rows(buckets: np.ndarray, bounds: list[int], labels: np.ndarray) -> Model:
    """The model of documents whose distinct buckets lie between the bounds."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(8)
    for _ in range(EPOCHS):
        for i in order.permutation(len(bounds) - 1):
            at = buckets[bounds[i] : bounds[i + 1]]
            w = weight(z[at], n[at])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - labels[i]
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept].astype(np.float32), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents, none of the held-out fold."""
    return fitted(labelled_sample(docs, labels, "toxic", 3, 1, sample_rows, SAMPLE_BYTES), fit)


def scores(texts: pa.Array, table: np.ndarray, constant: float) -> np.ndarray:
    """The probability of label 1 for each whole text."""
    keys = []
    for buckets, at, bounds in features(texts):
        used = np.flatnonzero(table[buckets])
        owners = np.searchsorted(bounds, at[used], "right") - 1
        keys.append(owners << BITS | buckets[used])
    keys = np.unique(np.concatenate(keys))
    sums = np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(sums + constant, -30, 30)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for piece in pieces(batches, most=PIECE_BYTES):
            p = scores(piece.column("text"), table, model.constant)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score under the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for piece in pieces(batches, most=PIECE_BYTES):
            yield piece.filter(pa.array(scores(piece.column("text"), table, model.constant) < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score_documents(docs, train(docs, labels))


