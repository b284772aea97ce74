"""Document quality by a small convolutional network over bytes, in numpy.

Each byte becomes a learned vector; learned filters look at 12 bytes at every fourth byte; a
filter's responses are max-pooled over chunks of 512 bytes that overlap by half and together cover
the whole text. The mean and the maximum of the chunks' pooled responses are combined by a logistic
layer into one probability, so that every part of a long text counts.

Edge cases: a null or empty text is one chunk of padding and is scored like any other. Without
labelled rows of both kinds every text gets the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import fitted, held_out, labelled_sample, pieces, text_buffers

EMBED, STEP, PARTS, FILTERS = 4, 4, 3, 24  # window: PARTS * STEP bytes, moved by STEP bytes
BLOCK = 256  # bytes; a chunk is two neighbouring blocks
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16_384
EPOCHS, BATCH, RATE = 6, 64, 0.02
THRESHOLD = 0.3
PIECE = 1 << 18


@dataclass
class Model:
    embedding: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (PARTS, STEP * EMBED, FILTERS)
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    constant: np.ndarray  # (1,)
    names: tuple[str, ...] = field(default=("embedding", "filters", "bias", "mean_weight", "max_weight", "constant"), repr=False)


@dataclass
class Pooled:
    """Responses of a batch of texts: by chunk, and how they meet in texts."""

    data: np.ndarray
    owner: np.ndarray  # text of each chunk
    top: np.ndarray  # (chunks, FILTERS) largest response
    window: np.ndarray | None  # the window that gave it
    bounds: np.ndarray  # chunks of texts


def new_model() -> Model:
    rng = np.random.default_rng(3)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(draw(256, EMBED, scale=0.5), draw(PARTS, STEP * EMBED, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.1), draw(FILTERS, scale=0.1), np.zeros(1, np.float32))


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, blocks before each text): each text padded with zero bytes to whole blocks.

    The windows that begin in a text end in its padding; the last PARTS - 1 windows of a text's blocks begin in
    the padding and would read the next text, so `pool` leaves them out.
    """
    sizes = np.diff(bounds)
    blocks = (sizes + (PARTS - 1) * STEP + BLOCK - 1) // BLOCK
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - bounds[:-1], sizes)] = data
    return out, first


def pool(model: Model, data: np.ndarray, first: np.ndarray, where: bool = False) -> Pooled:
    """Convolve and max-pool whole blocks; `where` also finds the windows of the maxima, for training."""
    per = BLOCK // STEP
    wide = np.concatenate(list(model.filters), axis=1)  # (STEP * EMBED, PARTS * FILTERS)
    total = len(data) // BLOCK
    best = np.empty((total, FILTERS), np.float32)
    at = np.empty((total, FILTERS), np.int64) if where else None
    vectors = np.ascontiguousarray(model.embedding).view(np.complex128)[:, 0]  # one item a byte gathers fastest
    lasts = np.zeros(total, bool)
    lasts[first[1:] - 1] = True
    stretch = 128
    for start in range(0, total, stretch):
        stop = min(start + stretch, total)
        raw = data[start * BLOCK : stop * BLOCK + (PARTS - 1) * STEP]
        if len(raw) < (stop - start) * BLOCK + (PARTS - 1) * STEP:
            raw = np.concatenate((raw, np.zeros((PARTS - 1) * STEP, np.uint8)))
        parts = vectors[raw].view(np.float32).reshape(-1, STEP * EMBED) @ wide
        count = (stop - start) * per
        response = parts[:count, :FILTERS].copy()
        for k in range(1, PARTS):
            response += parts[k : k + count, k * FILTERS : (k + 1) * FILTERS]
        response = response.reshape(stop - start, per, FILTERS)
        response[lasts[start:stop], per - (PARTS - 1) :] = -np.inf
        best[start:stop] = response.max(1)
        if where:
            at[start:stop] = response.argmax(1) + (np.arange(start, stop) * per)[:, None]
    blocks = np.diff(first)
    chunks = np.maximum(blocks - 1, 1)
    bounds = np.concatenate(([0], np.cumsum(chunks)))
    owner = np.repeat(np.arange(len(chunks)), chunks)
    left = np.arange(bounds[-1]) - bounds[owner] + first[owner]
    right = np.minimum(left + 1, first[owner + 1] - 1)
    top, window = np.maximum(best[left], best[right]), None
    if where:
        window = np.where(best[left] >= best[right], at[left], at[right])
    return Pooled(data, owner, top, window, bounds)


def combine(model: Model, p: Pooled) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, chunk features, their means, their maxima)."""
    active = np.maximum(p.top + model.bias, 0)
    starts = p.bounds[:-1]
    mean = np.add.reduceat(active, starts, axis=0) / np.diff(p.bounds)[:, None]
    most = np.maximum.reduceat(active, starts, axis=0)
    logit = mean @ model.mean_weight + most @ model.max_weight + model.constant
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))), active, mean, most


def gradients(model: Model, p: Pooled, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    prob, active, mean, most = combine(model, p)
    error = ((prob - labels) * weights / len(labels)).astype(np.float32)
    to_mean = error[:, None] * model.mean_weight / np.diff(p.bounds)[:, None]
    to_most = error[:, None] * model.max_weight
    is_most = active >= most[p.owner]
    is_most = is_most / np.add.reduceat(is_most.astype(np.float32), p.bounds[:-1], axis=0)[p.owner]  # ties share
    flow = (to_mean[p.owner] + to_most[p.owner] * is_most) * (active > 0)
    out = {
        "constant": error.sum(keepdims=True),
        "mean_weight": mean.T @ error,
        "max_weight": most.T @ error,
        "bias": flow.sum(0),
        "filters": np.zeros_like(model.filters),
        "embedding": np.zeros_like(model.embedding),
    }
    data = np.concatenate((p.data, np.zeros(PARTS * STEP, np.uint8)))
    flat = model.filters.reshape(PARTS * STEP * EMBED, FILTERS)
    moved = out["filters"].reshape(PARTS * STEP * EMBED, FILTERS)
    span = np.arange(PARTS * STEP)
    for f in range(FILTERS):
        used = np.flatnonzero(flow[:, f])
        if len(used) == 0:
            continue
        raw = data[p.window[used, f][:, None] * STEP + span]
        moved[:, f] = model.embedding[raw].reshape(len(used), -1).T @ flow[used, f]
        back = np.outer(flow[used, f], flat[:, f]).reshape(-1, EMBED)
        for e in range(EMBED):
            out["embedding"][:, e] += np.bincount(raw.ravel(), back[:, e], 256)
    return out


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """The model of the given texts, in memory, by Adam with balanced classes."""
    model = new_model()
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        model.mean_weight[:], model.max_weight[:] = 0, 0
        model.constant[:] = np.log(share / (1 - share))
        return model
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    data, bounds = text_buffers(texts)
    order, step = np.random.default_rng(5), 0
    first = {n: np.zeros_like(getattr(model, n)) for n in model.names}
    second = {n: np.zeros_like(getattr(model, n)) for n in model.names}
    batches = max(1, len(labels) // BATCH)
    for epoch in range(EPOCHS * max(1, 20 // batches)):
        for rows in np.array_split(order.permutation(len(labels)), batches):
            sizes = bounds[rows + 1] - bounds[rows]
            own = np.concatenate(([0], np.cumsum(sizes)))
            part = data[np.arange(own[-1]) + np.repeat(bounds[rows] - own[:-1], sizes)]
            found = gradients(model, pool(model, *padded(part, own), where=True), labels[rows], weights[rows])
            step += 1
            rate = RATE * (0.5 if epoch else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n, g in found.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                getattr(model, n)[...] -= (rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents, none of the held-out fold."""
    return fitted(labelled_sample(docs, labels, "quality", 5, 0, sample_rows, SAMPLE_BYTES), fit)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of label 1 for each whole text."""
    return combine(model, pool(model, *padded(*text_buffers(texts))))[0]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, most=PIECE):
            p = scores(model, piece.column("text"))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score_documents(docs, train(docs, labels))
