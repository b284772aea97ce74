"""Vectorised word hashes against their definition, and pieces of Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import words
from tidemark.llm.common import pieces, text_buffers

TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aBz09 .,\n-éÉßж漢😀_"))))


def split(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 40))
def test_word_hashes_follow_their_definition(texts, block):
    before, words.BLOCK = words.BLOCK, block
    try:
        hashes, bounds = words.word_hashes(pa.array(texts, pa.string()))
    finally:
        words.BLOCK = before
    lower = pa.compute.utf8_lower(pa.array(texts, pa.string())).to_pylist()
    for i, text in enumerate(lower):
        found = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert found == [words.word_hash(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def test_grams_stay_in_their_text():
    hashes, bounds = words.word_hashes(pa.array(["a b c", "", "b c d e"]))
    pairs, at = words.grams(hashes, bounds, (0, 1))
    assert at.tolist() == [0, 1, 3, 4, 5] and pairs[1] == pairs[2] and len(set(pairs.tolist())) == 4
    skips, at = words.grams(hashes, bounds, (0, 2))
    assert at.tolist() == [0, 3, 4] and len(set(skips.tolist())) == 3
    assert len(words.grams(hashes, bounds, (0, 9))[0]) == 0


def test_stems_are_prefixes():
    (whole, four), _ = words.stem_hashes(pa.array(["idiot idiotic cat"]), (None, 4))
    assert four[0] == four[1] != four[2] and four[2] == whole[2] and whole[0] != whole[1]


def test_pieces_keep_every_row():
    texts = ["x" * n for n in (0, 5, 100, 3, 3, 3, 50)] + [None, "é" * 9]
    batch = pa.RecordBatch.from_pydict({"text": texts, "id": list(range(len(texts)))})
    for most in (1, 6, 60, 10_000):
        found = list(pieces(iter([batch, batch.slice(0, 0)]), most=most))
        assert [i for p in found for i in p.column("id").to_pylist()] == list(range(len(texts)))
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most for p in found)


def test_sliced_arrays_are_read_from_their_offset():
    data, bounds = text_buffers(pa.array(["aa", "b", None, "cc"]).slice(1))
    assert bytes(data) == b"bcc" and bounds.tolist() == [0, 1, 1, 3]
    data, bounds = text_buffers(pa.array([], pa.string()))
    assert len(data) == 0 and bounds.tolist() == [0]
    assert np.array_equal(words.mix(np.zeros(1, np.uint64)), np.zeros(1, np.uint64))
