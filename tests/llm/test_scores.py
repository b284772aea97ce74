"""The two classifiers: held-out accuracy, training gradients, folds and edge cases."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality, toxicity, words
from tidemark.llm.common import labelled_sample, table
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    out = {}
    for name, column in (("op3_quality", "quality"), ("op8_toxicity", "toxic")):
        found = QUERIES[name](spark, SF).toPandas()
        labels = table(spark, SF, "labels").toPandas()
        out[name] = found, found.merge(labels, on="doc_id"), column
    return out


@pytest.mark.parametrize(("name", "modulus", "remainder", "threshold"), [("op3_quality", 5, 0, 0.3), ("op8_toxicity", 3, 1, 0.7)])
def test_contract(spark, scored, name, modulus, remainder, threshold):
    found, _, _ = scored[name]
    assert len(found) == table(spark, SF, "documents").count()
    assert found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= threshold)).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % modulus == remainder for i in found.doc_id]).all()


def test_held_out_accuracy(scored):
    _, known, _ = scored["op3_quality"]
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() > 0.96
    _, known, _ = scored["op8_toxicity"]
    held = known[known.held_out]
    toxic = held[held.toxic == 1]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.99
    assert (toxic.predicted == 1).mean() > 0.75


def test_the_sample_is_bounded_repeatable_and_without_the_fold(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    first = [r.text for r in labelled_sample(docs, labels, "toxic", 3, 1, 100, 5000).collect()]
    again = [r.text for r in labelled_sample(docs.repartition(7), labels, "toxic", 3, 1, 100, 5000).collect()]
    assert len(first) == 100 and first == again
    known = {r.text: r.doc_id for r in docs.collect()}
    assert all(len(t.encode()) <= 5000 for t in first)
    assert sum(zlib.crc32(str(known[t]).encode()) % 3 == 1 for t in first) <= 5  # copies of texts in the fold


def test_the_sample_is_of_documents_though_labels_cover_others(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 4000, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 3, 1, 20, 5000).count() == 20


TEXTS = ["", "a", "one two three four five", "Né vu vu VU 12-ab", "x" * 300, "the quick brown fox " * 40, "y z " * 63 + "end", "ü" * 511]


def plain_quality(model: quality.Model, text: str) -> float:
    """The network of one text, window by window."""
    raw = text.encode()
    span = quality.PARTS * quality.STEP
    blocks = max(1, -(-(len(raw) + span - quality.STEP) // quality.BLOCK))
    whole = raw + bytes(blocks * quality.BLOCK - len(raw))
    responses = {}
    for begin in range(0, len(whole) - span + 1, quality.STEP):
        values = np.concatenate([model.embedding[byte] for byte in whole[begin : begin + span]])
        responses[begin] = values @ model.filters.reshape(-1, quality.FILTERS)
    chunks = []
    for block in range(max(1, blocks - 1)):
        inside = [r for begin, r in responses.items() if block <= begin // quality.BLOCK <= block + 1]
        chunks.append(np.maximum(np.max(inside, axis=0) + model.bias, 0))
    logit = np.mean(chunks, axis=0) @ model.mean_weight + np.max(chunks, axis=0) @ model.max_weight + model.constant[0]
    return 1 / (1 + math.exp(-logit))


def test_quality_scores_equal_plain_loops_whatever_the_neighbours():
    model = quality.new_model()
    expected = [plain_quality(model, t) for t in TEXTS]
    for order in (range(8), reversed(range(8)), [0, 0, 3, 0, 7, 4, 5]):
        at = list(order)
        found = quality.scores(model, pa.array([TEXTS[i] for i in at]))
        assert np.allclose(found, [expected[i] for i in at], atol=1e-5)


def plain_features(text: str) -> set[int]:
    """The buckets of one text: words, pairs, pairs over one and two words, stems."""
    mask = 2**64 - 1
    spelled = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())

    def bucket(hashes: list[int], salt: int) -> int:
        total = (salt * 2 + 1) * int(words._BASE) & mask
        for h in hashes:
            total = (total * 0xD1342543DE82EF95 + h) & mask
            total ^= total >> 29
        return int(words.mix(np.array([total], np.uint64))[0]) >> (64 - toxicity.BITS)

    out = set()
    for salt, shape in enumerate(toxicity.SHAPES):
        for i in range(len(spelled) - max(shape)):
            out.add(bucket([words.word_hash(spelled[i + k]) for k in shape], salt))
    for salt, length in enumerate(toxicity.STEMS, len(toxicity.SHAPES)):
        out |= {bucket([words.word_hash(w[:length])], salt) for w in spelled}
    return out


def test_toxicity_equals_plain_loops():
    """Features, the FTRL update weight by weight, and the scores."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(30)] + ["é", "bad", "awful"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(80)] + TEXTS
    labels = np.array([int("bad" in t or "awful" in t) for t in texts])
    model = toxicity.fit(pa.array(texts), labels)
    rows = [sorted(plain_features(t)) for t in texts]
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(key) -> float:
        least = 0.0 if key is None else l1
        if abs(z[key]) <= least:
            return 0.0
        return -(z[key] - math.copysign(least, z[key])) / ((beta + math.sqrt(n[key])) / alpha + (0.0 if key is None else l2))

    order = np.random.default_rng(8)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            at = {key: weight(key) for key in [*rows[i], None]}
            g = 1 / (1 + math.exp(-sum(at.values()))) - labels[i]
            for key, w in at.items():
                z[key] += g - (math.sqrt(n[key] + g * g) - math.sqrt(n[key])) / alpha * w
                n[key] += g * g
    kept = {key: weight(key) for key in z if key is not None and weight(key)}
    assert set(model.buckets.tolist()) == set(kept) and 0 < len(kept) < len({k for r in rows for k in r})
    assert np.allclose(model.weights, [kept[k] for k in model.buckets.tolist()], atol=1e-4) and abs(model.constant - weight(None)) < 1e-6
    found = toxicity.scores(pa.array(texts), model.dense(), model.constant)
    plain = [1 / (1 + math.exp(-sum(kept.get(k, 0.0) for k in row) - model.constant)) for row in rows]
    assert np.allclose(found, plain, atol=1e-4)


def test_gradients_are_those_of_the_loss():
    """Analytic against numeric derivatives of a few weights of each kind."""
    model = quality.new_model()
    for name in model.names:
        setattr(model, name, getattr(model, name).astype(np.float64))
    texts = pa.array(["abc " * 300, "Hello, world", "", "x*** y%%% z" * 40])
    labels, weights = np.array([1, 1, 0, 0]), np.ones(4)
    data, first = quality.padded(*quality.text_buffers(texts))

    def loss() -> float:
        single = quality.Model(*(getattr(model, n).astype(np.float32) for n in model.names))
        prob = quality.combine(single, quality.pool(single, data, first))[0]
        return float(-np.mean(labels * np.log(prob) + (1 - labels) * np.log(1 - prob)))

    single = quality.Model(*(getattr(model, n).astype(np.float32) for n in model.names))
    found = quality.gradients(single, quality.pool(single, data, first, where=True), labels, weights)
    rng = np.random.default_rng(0)
    for name in model.names:
        array = getattr(model, name)
        largest = np.argsort(-np.abs(found[name]).ravel())[:2]
        for at in [*largest, rng.integers(array.size)]:
            before, step = array.flat[at], 1e-3
            array.flat[at] = before + step
            up = loss()
            array.flat[at] = before - step
            down = loss()
            array.flat[at] = before
            assert (up - down) / (2 * step) == pytest.approx(found[name].flat[at], abs=2e-3)


def test_windows_cover_the_whole_text():
    """A mark anywhere in a long text moves the pooled responses."""
    model = quality.new_model()
    base = "a" * 9000
    plain = quality.scores(model, pa.array([base]))[0]
    for at in (0, 4444, 8990):
        assert quality.scores(model, pa.array([base[:at] + "\x7f\x7f\x7f\x7f\x7f\x7f\x7f\x7f" + base[at + 8 :]]))[0] != plain


def test_toxicity_s_fit_holds_few_documents_features(monkeypatch):
    rng = random.Random(5)
    texts = pa.array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(1500)])
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "BITS", 16)
    features = sum(x.nbytes for i in range(0, 1500, 50) for x in toxicity._document_features(texts.slice(i, 50)))
    monkeypatch.setattr(toxicity, "FEATURES_AT_ONCE", 50, raising=False)
    tracemalloc.start()
    toxicity.fit(texts, np.arange(1500) % 2)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < features, (most, features)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, module):
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "idiot moron", None), (3, "word " * 100_000, 0.1), (3, "word " * 100_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, None, None), (3, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    operator = quality.quality if module is quality else toxicity.toxicity
    out = operator(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert operator(docs.limit(0), labels).collect() == []
    assert len({r.score for r in operator(docs, labels.limit(0)).collect()}) == 1
    scores = {r.doc_id: r.score for r in out}
    assert scores[1] == scores[2]


def test_rejected_documents_go_with_all_columns(spark):
    docs, labels = table(spark, SF, "documents").limit(3000), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    kept = toxicity.clean_documents(docs, model)
    assert kept.schema == docs.schema
    clean = toxicity.score_documents(docs, model).filter("predicted = 0").select("doc_id")
    assert kept.select("doc_id").exceptAll(clean).isEmpty() and clean.exceptAll(kept.select("doc_id")).isEmpty()
