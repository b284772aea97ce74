"""Benchmark decontamination by spaced seeds.

A seed is the hash of six words picked by a fixed mask out of a window of up to nine; the words the
mask passes over may differ. The four masks lose nothing: however a run of 13 or more words with IDENTITY
equal ones places its differing words, one mask fits between them (tried for all placements in runs of 13
to 25 words; of a longer run one half has IDENTITY too). Shorter items are sought as a whole, by masks of
their own length that keep the ends and leave out every choice of parts that may differ; below five
words no word may differ, so that all of them make the seed. Seeds of all benchmark windows go into a Bloom filter of fixed size
(the only thing broadcast). Documents are read once: windows whose seeds pass the filter are hits,
and the words around neighbouring hits leave as one stretch. Hits are joined with the benchmark's
seeds by hash, which gives places where an item may lie over the document; there document and item
are laid side by side, and the longest run with at least IDENTITY equal words is the overlap. A document
leaks an item if the overlap has LEAST_WORDS words, or the whole item where that is shorter.

Nothing is a pair of document and item before a seed joins them, and what moves is hits and the
words around them, never whole documents.

Edge cases: an overlap begins and ends with an equal word, so an item under LEAST_WORDS words leaks if its
first and last word are equal and IDENTITY of all; items without words are not sought; null texts have no words; repeated rows of one doc_id and text are
one document; a null doc_id is reported as null; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, pieces, quoted, written
from tidemark.llm.words import grams, last_of_text, word_hashes

MASKS = ("11101011", "111111", "110110011", "101001111")
SHORT = 1
LEAST_WORDS, IDENTITY = 13, 0.8
FILTER_BITS, SHIFTS = 24, (0, 20, 40)  # a filter of 2 MB; a seed sets a bit for each 24 of its bits
SPAN = max(map(len, MASKS))
PARTS = 5  # of the inner words of a short item; a seed leaves out as many parts as words may differ


def offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def short_masks(size: int) -> list[tuple[int, ...]]:
    """Offsets for an item of `size` words, under LEAST_WORDS: some choice holds no differing word."""
    parts = np.array_split(np.arange(1, size - 1), PARTS)
    left_out = itertools.combinations([p for p in parts if len(p)], size - math.ceil(IDENTITY * size))
    return [tuple(i for i in range(size) if not any(i in part for part in out)) for out in left_out]


def seeds(words: np.ndarray, bounds: np.ndarray, short: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(seeds, first words, size) for every mask: for items of `size` words, or of LEAST_WORDS and more for that."""
    for k, mask in enumerate(MASKS):
        found, at = grams(words, bounds, offsets(mask), k)
        yield found.view(np.int64), at, LEAST_WORDS
    for size in short:
        inside = last_of_text(bounds, size - 1)
        for k, chosen in enumerate(short_masks(size)):
            found, at = grams(words, bounds, chosen, 16 * size + k)
            yield found[inside[at]].view(np.int64), at[inside[at]], size


def item_seeds(benchmark: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """(seed, item_id, _item, at): `_item` names the item's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words, bounds = word_hashes(piece.column("text"))
            sizes = np.diff(bounds)
            for found, at, size in seeds(words, bounds, short):
                owner = np.searchsorted(bounds, at, "right") - 1
                use = sizes[owner] == size if size < LEAST_WORDS else sizes[owner] >= LEAST_WORDS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[use]), piece.column("_item").take(pa.array(owner[use])), pa.array((at - bounds[owner])[use])],
                    ["seed", "_item", "at"],
                )

    return benchmark.mapInArrow(run, "seed long, _item long, at long")


def bloom(found: DataFrame) -> np.ndarray:
    """The filter's bits, built by Spark; 2 MB whatever the benchmark's size."""
    probes = F.explode(F.array(*(F.shiftrightunsigned("seed", s).bitwiseAND((1 << FILTER_BITS) - 1) for s in SHIFTS)))
    parts = found.select(probes.alias("bit")).selectExpr("bitmap_bucket_number(bit + 1) as part", "bitmap_bit_position(bit + 1) as at")
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in parts.groupBy("part").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).collect():
        begin = (row["part"] - 1) * 4096
        bits[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def passes(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of the seeds that may be in the filter."""
    at = np.arange(len(found))
    raw = found.view(np.uint64)
    for shift in SHIFTS:
        bit = (raw[at] >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        at = at[bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return at


def stretches(docs: DataFrame, bits: np.ndarray, short: tuple[int, ...], reach: int) -> DataFrame:
    """(doc_id, _doc, start, words, seeds, places) of the parts of documents around hits.

    `start` is the first word's place, `words` the hashes from there, `places` those of the hits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words, bounds = word_hashes(piece.column("text"))
            hits, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for found, at, size in seeds(words, bounds, short):
                use = passes(shared.value, found)
                if size < PARTS and len(use):  # all hits are equal copies; the first of a text is the one reported
                    owner = np.searchsorted(bounds, at[use], "right") - 1
                    order = np.lexsort((at[use], found[use], owner))
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = (np.diff(owner[order]) != 0) | (np.diff(found[use][order]) != 0)
                    use = use[order[fresh]]
                hits.append(found[use])
                places.append(at[use])
            hit, place = np.concatenate(hits), np.concatenate(places)
            if len(hit) == 0:
                continue
            order = np.argsort(place, kind="stable")
            hit, place = hit[order], place[order]
            owner = np.searchsorted(bounds, place, "right") - 1
            new = np.ones(len(place), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (place[1:] - place[:-1] > 2 * reach)
            first = np.append(np.flatnonzero(new), len(place))
            rows = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                row = owner[a]
                low = max(bounds[row], place[a] - reach)
                high = min(bounds[row + 1], place[b - 1] + SPAN + reach)
                rows.append((int(row), int(low - bounds[row]), words[low:high].tobytes(), hit[a:b].tolist(), (place[a:b] - bounds[row]).tolist()))
            index, starts, raw, own, where = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(index)), piece.column("_doc").take(pa.array(index)), pa.array(starts, pa.int64()), pa.array(raw, pa.binary()), pa.array(own, pa.list_(pa.int64())), pa.array(where, pa.list_(pa.int64()))],
                ["doc_id", "_doc", "start", "words", "seeds", "places"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_doc"), "text")
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, _doc long, start long, words binary, seeds array<bigint>, places array<bigint>")


def longest_run(equal: np.ndarray) -> tuple[int, int]:
    """(first, past) of the longest stretch of which at least IDENTITY is true, cut to true ends."""
    sums = np.concatenate(([0], np.cumsum(np.round((equal - IDENTITY) * 1000).astype(np.int64))))
    lows = np.minimum.accumulate(sums)
    first = np.searchsorted(-lows, -sums, "left")  # the first place from which the sum up to here is not negative
    length = np.arange(len(sums)) - first
    past = int(np.argmax(length))
    begin = int(first[past])
    inside = np.flatnonzero(equal[begin:past])
    return (begin + int(inside[0]), begin + int(inside[-1]) + 1) if len(inside) else (0, 0)


def overlap(stretch: np.ndarray, start: int, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """(words, equal words, first, past in the item) of the overlap where item word i lies over document word i + shift."""
    low, high = max(0, start - shift), min(len(item), start + len(stretch) - shift)
    if high <= low:
        return 0, 0, 0, 0
    equal = stretch[low + shift - start : high + shift - start] == item[low:high]
    first, past = longest_run(equal)
    return past - first, int(equal[first:past].sum()), low + first, low + past


def found_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, _doc, item_id, n_words, n_equal, item_words, doc_start, doc_end), the longest overlap of each document and item."""
    items = benchmark.filter("text is not null").select("item_id", F.xxhash64("item_id", "text").alias("_item"), "text").dropDuplicates(["_item"])
    items = written(with_words(items), "items")
    sizes = items.selectExpr("octet_length(words) div 8 as n").filter(f"n >= {SHORT}")
    short = tuple(sorted(r["n"] for r in sizes.filter(f"n < {LEAST_WORDS}").distinct().collect()))  # LEAST_WORDS - SHORT lengths at most
    reach = (sizes.agg(F.max("n")).first()[0] or 0) + SPAN  # an item that holds the hit lies within
    index = written(item_seeds(items.select("_item", "text"), short), "seeds")
    near = written(stretches(docs, bloom(index), short, reach), "stretches")
    hits = near.select("_doc", "start", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).selectExpr("_doc", "start", "hit.seeds as seed", "hit.places as place")
    places = hits.join(index, "seed").selectExpr("_doc", "start", "_item", "place - at as shift").distinct()
    sides = places.join(near.select("doc_id", "_doc", "start", "words").dropDuplicates(["_doc", "start"]), ["_doc", "start"])
    sides = sides.join(items.selectExpr("_item", "item_id", "words as item"), "_item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for i in range(batch.num_rows):
                stretch, start, item, shift = (batch.column(n)[i].as_py() for n in ("words", "start", "item", "shift"))
                words = np.frombuffer(item, np.uint64)
                size, equal, first, past = overlap(np.frombuffer(stretch, np.uint64), start, words, shift)
                if size >= min(LEAST_WORDS, len(words)):
                    out.append((i, size, equal, len(words), first + shift, past + shift))
            if out:
                index, *columns = zip(*out, strict=True)
                rows = batch.take(pa.array(index))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("_doc"), rows.column("item_id"), *(pa.array(c, pa.int64()) for c in columns)],
                    ["doc_id", "_doc", "item_id", "n_words", "n_equal", "item_words", "doc_start", "doc_end"],
                )

    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    pairs = sides.mapInArrow(run, f"doc_id {kinds[0]}, _doc long, item_id {kinds[1]}, n_words long, n_equal long, item_words long, doc_start long, doc_end long")
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("s"), "item_words", "doc_end")).alias("best")
    return pairs.groupBy("doc_id", "_doc", "item_id").agg(best).selectExpr(
        "doc_id", "_doc", "item_id", "best.n_words", "best.n_equal", "best.item_words", "-best.s as doc_start", "best.doc_end"
    )


def with_words(items: DataFrame) -> DataFrame:
    """Adds the hashes of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words, bounds = word_hashes(piece.column("text"))
            raw = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(raw, pa.binary())], [*piece.schema.names, "words"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, f"{schema}, words binary")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking document and item, with the overlap in words."""
    return found_leaks(docs, benchmark).drop("_doc")


def unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that leak no item, with all their columns."""
    gone = written(found_leaks(docs, benchmark).select(F.col("_doc").alias("_gone")).distinct(), "leaking")
    rows = docs.select(F.struct(*quoted(docs)).alias("_row"), F.xxhash64("doc_id", "text").alias("_doc"))
    return rows.join(gone, F.col("_doc") == F.col("_gone"), "left_anti").select("_row.*")
