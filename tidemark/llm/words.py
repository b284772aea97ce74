"""Words of many texts at once as 64-bit hashes, without a Python object per word.

A word is a longest run of ASCII letters, digits and bytes over 127, in lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import text_buffers

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_VALUE[~_LETTER] = 0
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, 1 << (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES[size] = _powers(int(_BASE), size), _powers(_INVERSE, size)
    return _TABLES[size]


def word_hash(word: bytes) -> int:
    """The hash of one word in lower case, by its definition."""
    total = 0
    for i, byte in enumerate(word):
        total += int(_VALUE[byte]) * pow(int(_BASE), i, 1 << 64)
    return int(mix(np.array([(total + len(word)) & (2**64 - 1)], np.uint64))[0])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    (hashes,), bounds = stem_hashes(texts, (None,))
    return hashes, bounds


def stem_hashes(texts: pa.Array, lengths: tuple[int | None, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """As `word_hashes`, but an array for each length: of the words' first bytes, or of whole words for None."""
    data, bounds = text_buffers(pc.utf8_lower(texts))
    hashes, starts = [[] for _ in lengths], []
    at, total = 0, len(data)
    while at < total:
        stop, letters = min(at + BLOCK, total), None
        while True:  # cut where no word is cut
            letters = _LETTER[data[at:stop]]
            if stop == total:
                break
            gaps = np.flatnonzero(~letters)
            inner = bounds[np.searchsorted(bounds, stop, "right") - 1]
            cut = max(int(gaps[-1]) + at + 1 if len(gaps) else at, int(inner))
            if cut > at:
                stop, letters = cut, letters[: cut - at]
                break
            stop = min(stop + (stop - at), total)
        edge = np.zeros(stop - at + 1, bool)  # where a text begins
        inside = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop, "right")] - at
        edge[inside] = True
        edge[0] = edge[-1] = True
        before = np.empty_like(letters)
        before[0] = False
        before[1:] = letters[:-1]
        first = np.flatnonzero(letters & (~before | edge[:-1]))
        after = np.empty_like(letters)
        after[-1] = False
        after[:-1] = letters[1:]
        last = np.flatnonzero(letters & (~after | edge[1:])) + 1
        up, down = _tables(stop - at)
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_VALUE[data[at:stop]] * up[: stop - at], out=sums[1:])
        for found, length in zip(hashes, lengths, strict=True):
            end = last if length is None else np.minimum(last, first + length)
            found.append(mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)))
        starts.append(first + at)
        at = stop
    if not starts:
        return [np.empty(0, np.uint64) for _ in lengths], np.zeros(len(bounds), np.int64)
    return [np.concatenate(x) for x in hashes], np.searchsorted(np.concatenate(starts), bounds)


def last_of_text(bounds: np.ndarray, gap: int) -> np.ndarray:
    """For word i: whether word i + gap is still in its text."""
    total = int(bounds[-1])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total) + gap < ends


def grams(hashes: np.ndarray, bounds: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of the words at i + offset for each offset, for each i for which they are in one text."""
    reach = max(offsets)
    if len(hashes) <= reach:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(last_of_text(bounds, reach))
    total = np.full(len(hashes) - reach, (salt * 2 + 1) * int(_BASE) % 2**64, np.uint64)
    for k in offsets:
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[k : len(hashes) - reach + k]
        total ^= total >> np.uint64(29)
    return mix(total[at]), at
