"""Near-duplicates by DartMinHash signatures of weighted word shingles, banded joins and exact checks.

A text's elements are its runs of five words, weighted by how often they occur; similarity is the
weighted Jaccard index, and texts at SIMILARITY or more are linked. Classes are the connected
components of links.

Signatures: an element of weight w owns a strip of the plane weight x rank, cut into unit cells. A hash
of element and cell says how many darts fell into the cell (Poisson, mean 1), and where: each dart has
a rank and one of DARTS coordinates. The signature holds the earliest dart of every coordinate. A text of
total weight W looks at ranks up to about DARTS * (ln DARTS + 3) / W, hence at as many darts
whatever its length; ranks are doubled where a coordinate is still empty.

Joining: texts of equal words are one representative. Representatives meet in buckets, by bands
of 5 and of 10 coordinates (a pair at similarity 0.8 shares a bucket but for 5 in 100,000). A bucket is
never expanded into pairs. In every round each bucket that still holds several components picks
heads by hashes, one of a component; of the heads of other components, a member proposes itself to the one that it meets in most
buckets, so a round has no more pairs than members. They are compared (first by agreement of
signatures with wide margin, then exactly by their elements), and components are joined up. Later
rounds part the buckets by up to three further coordinates, others each time, so that members meet
heads ever more like them. All joins are by bucket or
representative, which adaptive execution can split when one is hot.

The rounds only make components fewer; what they leave is finished exactly. In every bucket of 5 coordinates
(those of 10 are parts of them) that still holds several components, every text outside the most frequent one
meets the texts of other components with which it shares one of its rarest elements (as many as a similar text
cannot lack), and common elements are counted. Components once linked meet no more. A large bucket is cut
into blocks of bytes, and each pair of blocks is a group of its own. So links are missed only between texts that
share no bucket.

Edge cases: null is the empty text; texts without words are alike if they are equal; texts of one to four
words have a single element, so they are linked if their words are equal. Repeated rows and rows of one
doc_id are rows of their own. A class is named by its smallest doc_id (null if it has none), which is also
the row that stays; of repeated such rows one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, pieces, quoted, text_buffers, written
from tidemark.llm.words import grams, mix, word_hashes

WORDS, SIMILARITY = 5, 0.8
DARTS, NARROW, WIDE = 128, 5, 10
MARGIN = 0.12  # below SIMILARITY; over three deviations of the estimate by 128 coordinates
HEADS = 4  # of each part of a bucket after the first round, which has one
# Bytes of `more`, further coordinates that part a bucket, by round: none; then three, one and two at once; then one each.
PARTS = ((0,), (0xFFFFFF, 0xFF << 24, 0xFFFF << 32), (0xFF << 40, 0xFF << 48, 0x7F << 56))
BLOCK_BYTES = 4 << 20  # of elements on either side of a group
FILTER_BYTES = 3  # of a name: a filter of 2 MB; a fuller one lets more pass and loses nothing
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POISSON = (np.cumsum([np.exp(-1) / f for f in np.cumprod([1.0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])]) * 2.0**53).astype(np.uint64)


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(elements, their bounds, word hashes, their bounds) of texts."""
    words, bounds = word_hashes(texts)
    sizes = np.diff(bounds)
    found, at = grams(words, bounds, tuple(range(WORDS)), 5)
    owners = np.searchsorted(bounds, at, "right") - 1
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        place = np.arange(WORDS, dtype=np.uint64) * _TURN
        whole = np.array([mix(words[bounds[i] : bounds[i + 1]] + place[: sizes[i]]).sum() for i in short], np.uint64)
        found, owners = np.concatenate((found, whole)), np.concatenate((owners, short))
        order = np.argsort(owners, kind="stable")
        found, owners = found[order], owners[order]
    return found, np.searchsorted(owners, np.arange(len(texts) + 1)), words, bounds


def cells(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: of the element and how many equal ones the text had before. Sorted within texts."""
    owners = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    starts = np.flatnonzero(fresh)
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    return mix(found + nth.astype(np.uint64) * _TURN)


def signatures(units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, DARTS) 32-bit names of the earliest darts; texts without elements have zeros."""
    weights = np.diff(bounds)
    best = np.full(len(weights) * DARTS, np.iinfo(np.uint64).max, np.uint64)
    enough = DARTS * (np.log(DARTS) + 3)
    reach = np.where(weights > 0, np.ceil(enough / np.maximum(weights, 1)), 0).astype(np.int64)
    done = np.zeros(len(weights), np.int64)
    while True:
        open_ = np.flatnonzero(done < reach)
        if len(open_) == 0:
            break
        for group in np.array_split(open_, max(1, int((weights[open_] * (reach - done)[open_]).sum()) >> 20)):
            if len(group) == 0:
                continue
            counts = weights[group]
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            base = units[np.repeat(bounds[group], counts) + inside]
            ranks = np.repeat((reach - done)[group], counts)
            cell = np.repeat(np.arange(len(base)), ranks)
            rank = np.arange(len(cell)) - np.repeat(np.cumsum(ranks) - ranks, ranks) + np.repeat(np.repeat(done[group], counts), ranks)
            seed = mix(base[cell] + (rank.astype(np.uint64) + np.uint64(1)) * _STEP)
            thrown = np.searchsorted(_POISSON, seed >> np.uint64(11), "right")
            dart = np.repeat(np.arange(len(seed)), thrown)
            number = np.arange(len(dart)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
            hashed = mix(seed[dart] + (number.astype(np.uint64) + np.uint64(1)) * _TURN)
            place = np.repeat(np.repeat(group, counts), ranks)[dart] * DARTS + (hashed % np.uint64(DARTS)).astype(np.int64)
            np.minimum.at(best, place, rank[dart].astype(np.uint64) << np.uint64(50) | hashed >> np.uint64(14))
        done = np.maximum(done, reach)
        empty = (best.reshape(-1, DARTS) == np.iinfo(np.uint64).max).any(1) & (weights > 0)
        reach = np.where(empty, 2 * done, reach)
    out = (mix(best) >> np.uint64(32)).astype(np.uint32).reshape(-1, DARTS)
    out[weights == 0] = 0
    return out


def names(texts: pa.Array, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2) 64-bit numbers that equal words in equal order share; of the raw text if it has no words."""
    sizes = np.diff(bounds)
    at = np.arange(len(words)) - np.repeat(bounds[:-1], sizes)
    out = np.zeros((len(sizes), 2), np.uint64)
    some = np.flatnonzero(sizes)
    for k in (0, 1):
        turned = mix(mix(words + np.uint64((k + 1) * int(_TURN) % 2**64)) + at.astype(np.uint64) * _STEP)
        if len(some):
            out[some, k] = mix(np.add.reduceat(turned, bounds[some]) + sizes[some].astype(np.uint64))
    if len(some) < len(sizes):
        data, ends = text_buffers(texts)
        for i in np.flatnonzero(sizes == 0):
            out[i] = np.frombuffer(hashlib.blake2b(data[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest(), np.uint64)
    return out


def _binary(rows: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def marked(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, _h (a hash of the text), rid (name of its words), signature (empty: no elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, most=1 << 20):
            texts = piece.column("text")
            found, limits, words, bounds = elements(texts)
            drawn = signatures(cells(found, limits), limits)
            rid = names(texts, words, bounds)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("_h"), _binary(rid, 16), pa.array([d.tobytes() if n else b"" for d, n in zip(drawn, np.diff(limits), strict=True)], pa.binary())],
                ["doc_id", "_h", "rid", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, _h long, rid binary, signature binary")


def bands(reps: DataFrame) -> DataFrame:
    """(band, rid, more): hashes of 5 (odd) and of 10 (even) coordinates in a row, and a byte each of eight others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.binary_length(batch.column("signature")), 0))
            if batch.num_rows == 0:
                continue
            drawn = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, DARTS).astype(np.uint64)
            keys, others = [], []
            for width in (NARROW, WIDE):
                count = DARTS // width
                parts = drawn[:, : count * width].reshape(-1, count, width)
                key = np.tile(np.arange(count, dtype=np.uint64) + np.uint64(1000 * width), (len(drawn), 1))
                for c in range(width):
                    key = mix(key * _STEP + parts[:, :, c])
                keys.append(key | np.uint64(1) if width == NARROW else key & ~np.uint64(1))
                at = (np.arange(count)[:, None] * width + width + np.arange(8) * 13 % (DARTS - width)) % DARTS
                others.append(np.ascontiguousarray(drawn.astype(np.uint8)[:, at]).reshape(len(drawn), -1).view(np.int64))
            key = np.concatenate(keys, axis=1)
            more = np.concatenate(others, axis=1)
            rows = np.repeat(np.arange(len(drawn)), key.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column("rid").take(pa.array(rows)), pa.array(more.ravel())], ["band", "rid", "more"])

    return reps.select("rid", "signature").mapInArrow(frugal(run), "band long, rid binary, more long")


def element_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, units) of the representatives in `wanted`: their elements as sorted 32-bit hashes of units of weight.

    The texts are found by a filter of fixed size, in one pass over the documents without a shuffle of texts.
    """
    bit = F.conv(F.hex(F.substring("rid", 1, FILTER_BYTES)), 16, 10).cast("long")
    parts = wanted.select(bit.alias("bit")).selectExpr("bitmap_bucket_number(bit) as part", "bitmap_bit_position(bit) as at")
    rows = parts.groupBy("part").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).collect()  # 2 MB at most
    bits = np.zeros((1 << 8 * FILTER_BYTES) // 8 + 4096, np.uint8)
    for row in rows:  # buckets of 4,096 bytes, numbered from 1 but for bit 0
        begin = max(row["part"] - 1, 0) * 4096
        bits[begin : begin + 4096] |= np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, most=1 << 20):
            rid = names(piece.column("text"), *word_hashes(piece.column("text")))
            head = rid.view(np.uint8).reshape(len(rid), 16)[:, :FILTER_BYTES].astype(np.int64)
            at = _places(head)
            hit = np.flatnonzero(shared.value[at // 8] >> (at % 8).astype(np.uint8) & 1)
            if len(hit) == 0:
                continue
            found, limits, _, _ = elements(piece.column("text").take(pa.array(hit)))
            units = (cells(found, limits) >> np.uint64(32)).astype(np.uint32)
            out = [np.sort(units[a:b]).tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([_binary(rid[hit], 16), pa.array(out, pa.binary())], ["rid", "units"])

    table = docs.select("text").mapInArrow(frugal(run), "rid binary, units binary")
    return table.groupBy("rid").agg(F.first("units").alias("units"))


def _places(head: np.ndarray) -> np.ndarray:
    """The filter's bit for the first bytes of a name, as bitmap_bit_position and bitmap_bucket_number place it."""
    value = np.zeros(len(head), np.int64)
    for byte in head.T:
        value = value << 8 | byte
    return np.where(value == 0, 0, value - 1)


def compared(pairs: DataFrame, table: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, z, and more) whose values of `column` in `table` (by rid) pass `keep`."""
    side = lambda key, name: table.select(F.col("rid").alias(key), F.col(column).alias(name))
    both = pairs.join(side("a", "_a"), "a").join(side("z", "_z"), "z").select(*pairs.columns, "_a", "_z")
    own = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [keep(x, y) for x, y in zip(batch.column("_a").to_pylist(), batch.column("_z").to_pylist(), strict=True)]
            yield batch.select(own).filter(pa.array(passed, pa.bool_()))

    return both.mapInArrow(frugal(run), pairs.schema)


def perhaps(a: bytes, z: bytes) -> bool:
    """Whether signatures agree in so many coordinates that the texts may be similar."""
    return int((np.frombuffer(a, np.uint8) == np.frombuffer(z, np.uint8)).sum()) >= DARTS * (SIMILARITY - MARGIN)


def similarity(a: bytes, z: bytes) -> float:
    """Weighted Jaccard index of two texts' elements."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(z, np.uint32)
    if len(x) == 0 or len(y) == 0:
        return 0.0
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def similar(a: bytes, z: bytes) -> bool:
    return similarity(a, z) >= SIMILARITY


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of links (a, z) that are not the smallest of their component.

    Large-star and small-star steps: every step points a node's neighbours to the smallest of
    them, until every node points to one that points nowhere. Minima are combined before they
    are shuffled.
    """
    edges = links.filter("a <> z").selectExpr("greatest(a, z) as u", "least(a, z) as v")
    while True:
        near = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        edges = near.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.selectExpr("u", "m as v").unionByName(joined.filter("v <> m").selectExpr("v as u", "m as v")).distinct()
        edges = written(edges, "components")
        ends = edges.selectExpr("u as node", "1 as up", "0 as down").unionByName(edges.selectExpr("v as node", "0 as up", "1 as down"))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            return edges.selectExpr("u as node", "v as comp")


def links_of(docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(rid, comp) of the representatives that share buckets; None if there are none."""
    every = bands(reps)
    shared = every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    buckets = written(every.join(shared, "band"), "buckets")
    labels = written(buckets.selectExpr("rid", "rid as comp").distinct(), "labels")
    if labels.isEmpty():
        return None
    table = written(element_table(docs, labels), "elements")
    digests = written(digest(reps.join(labels, "rid", "left_semi")), "digests")
    for round_, masks in enumerate(PARTS):
        cut = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.col("more").bitwiseAND(m).alias("rest")) for m in masks)))
        parts = buckets.join(labels, "rid").select("band", "rid", "comp", cut.alias("part"))
        heads = heads_of(parts, round_)
        pairs = proposals(parts.join(heads, ["band", "part"]).filter("comp <> head_comp"))
        pairs = written(compared(pairs, digests, "digest", perhaps), "pairs")
        links = written(compared(pairs, table, "units", similar), "links")
        labels = joined_up(labels, links.selectExpr("comp as a", "head_comp as z"))
    return joined_up(labels, rest_of_links(buckets.filter("band & 1 = 1").join(labels, "rid").select("band", "rid", "comp"), table))


def heads_of(parts: DataFrame, round_: int) -> DataFrame:
    """(band, part, head, head_comp) of the parts (band, rid, comp, part) that hold several components: heads by hash, one of a component."""
    first = lambda k: F.min(F.struct(F.xxhash64("rid", F.lit(100 * round_ + k)).alias("h"), "rid", "comp"))
    chosen = F.array(*(first(k) for k in range(HEADS if round_ else 1))).alias("heads")
    heads = parts.groupBy("band", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), chosen).filter("lo <> hi")
    new = "filter(heads, (x, i) -> not exists(slice(heads, 1, i), y -> y.comp = x.comp))"
    return heads.select("band", "part", F.explode(F.expr(new)).alias("head")).selectExpr("band", "part", "head.rid as head", "head.comp as head_comp")


def proposals(met: DataFrame) -> DataFrame:
    """(a, z, comp, head_comp): of the heads that a member met (rid, comp, head, head_comp, a row for each meeting), the one it met most often."""
    often = met.groupBy("rid", "comp", "head", "head_comp").agg(F.count("*").alias("n"))
    best = often.groupBy("rid", "comp").agg(F.max(F.struct("n", F.xxhash64("head").alias("h"), "head", "head_comp")).alias("best"))
    return best.selectExpr("rid as a", "best.head as z", "comp", "best.head_comp as head_comp")


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` with the components (a, z) that `links` joins as one."""
    links = written(links.distinct(), "joins")
    if links.isEmpty():
        return labels
    merged = components(links)
    moved = labels.join(merged, labels["comp"] == merged["node"], "left")
    return written(moved.select("rid", F.coalesce(merged["comp"], labels["comp"]).alias("comp")), "labels")


def ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at `low`, one after another."""
    return np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


def linked(probes: list[tuple[bytes, bytes]], members: list[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
    """Pairs of components that join up all similar texts of `probes` and `members`, both (comp, units).

    Similar texts have at least SIMILARITY of either's units in common. So they have one in common among the
    rest and one more of either's units, whatever the order of units: here the rarest come first.
    """
    found: set[tuple[bytes, bytes]] = set()
    probes, members = ([x for x in side if x[1]] for side in (probes, members))
    if not probes or not members:
        return found
    numbers = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in members + probes))}
    named, top = list(numbers), np.arange(len(numbers))  # top: what the links so far have joined
    of = np.array([numbers[c] for c, _ in members])
    sizes = np.array([len(raw) // 4 for _, raw in members])
    first = lambda size: size - np.ceil(SIMILARITY * size - 1e-6).astype(np.int64) + 1
    known, every, counts = np.unique(np.frombuffer(b"".join(raw for _, raw in members), np.uint32), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(known))
    owner = np.repeat(np.arange(len(members)), sizes)
    every = np.sort(owner * len(known) + rank[every]) - owner * len(known)
    bounds = np.cumsum(sizes) - sizes
    index = ranges(bounds, first(sizes))
    index, holder = every[index], owner[index]
    holder = holder[np.argsort(index, kind="stable")]
    ends = np.cumsum(np.bincount(index, minlength=len(known)))
    begins, hits = np.append(0, ends[:-1]), np.zeros(len(known), np.int64)
    for comp, raw in probes:
        mine, units = numbers[comp], np.frombuffer(raw, np.uint32)
        at = np.minimum(np.searchsorted(known, units), len(known) - 1)
        own = np.sort(rank[at[known[at] == units]])
        rare = own[: max(0, int(first(len(units))) - (len(units) - len(own)))]  # before them, units that no member has
        met = np.unique(holder[ranges(begins[rare], ends[rare] - begins[rare])])
        met = met[top[of[met]] != top[mine]]
        met = met[(sizes[met] >= SIMILARITY * len(units)) & (len(units) >= SIMILARITY * sizes[met])]
        if len(met) == 0:
            continue
        np.add.at(hits, own, 1)
        common = np.add.reduceat(hits[every[ranges(bounds[met], sizes[met])]], np.cumsum(sizes[met]) - sizes[met])
        hits[own] = 0
        for other in np.unique(of[met[common >= SIMILARITY * (sizes[met] + len(units) - common)]]):
            if top[other] != top[mine]:
                found.add((max(comp, named[other]), min(comp, named[other])))
                top[top == top[other]] = top[mine]
    return found


def rest_of_links(held: DataFrame, table: DataFrame) -> DataFrame:
    """(a, z): components of all similar texts of one bucket (band, rid, comp) that are in different ones."""
    by_comp = held.groupBy("band", "comp").agg(F.count("*").alias("n"))
    most = by_comp.groupBy("band").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("most")).filter("comps > 1")
    open_ = written(held.join(most.select("band", "most"), "band"), "open")
    sizes = open_.join(table.selectExpr("rid", "length(units) as size"), "rid").groupBy("band")
    blocks = sizes.agg(F.expr(f"1 + sum(size) div {BLOCK_BYTES} as columns"), F.expr(f"1 + sum(if(comp <> most, size, 0)) div {BLOCK_BYTES} as lines"))
    rows = open_.join(blocks, "band")
    index = rows.selectExpr("band", "rid", "comp", "false as probe", "pmod(xxhash64(rid, 1), columns) as j", "explode(sequence(0L, lines - 1)) as i")
    probes = rows.filter("comp <> most").selectExpr("band", "rid", "comp", "true as probe", "explode(sequence(0L, columns - 1)) as j", "pmod(xxhash64(rid, 2), lines) as i")
    groups = index.unionByName(probes).join(table, "rid").select("band", "i", "j", "probe", "comp", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(found: set) -> pa.RecordBatch:
            a, z = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(z, pa.binary())], ["a", "z"])

        key, sides = None, ([], [])
        for batch in batches:
            for band, i, j, probe, comp, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != key:
                    if sides[0] and sides[1] and (found := linked(sides[1], sides[0])):
                        yield pairs(found)
                    key, sides = (band, i, j), ([], [])
                sides[probe].append((comp, units))
        if sides[0] and sides[1] and (found := linked(sides[1], sides[0])):
            yield pairs(found)

    return groups.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(frugal(run), "a binary, z binary")


def digest(reps: DataFrame) -> DataFrame:
    """(rid, digest): one byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, DARTS)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), _binary(drawn.astype(np.uint8), DARTS)], ["rid", "digest"])

    return reps.filter("length(signature) > 0").select("rid", "signature").mapInArrow(frugal(run), "rid binary, digest binary")


def classified(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, _h, class_id, class_size, and n, how many rows like it its class's kept place has (0: it goes)."""
    marks = written(marked(docs.select("doc_id", "text")), "marks")
    reps = marks.groupBy("rid").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("signature").alias("signature"))
    reps = written(reps, "representatives")
    labels = links_of(docs, reps)
    slim = reps.selectExpr("rid", "rid as comp", "first", "n")
    if labels is not None:
        slim = reps.join(labels, "rid", "left").selectExpr("rid", "coalesce(comp, rid) as comp", "first", "n")
    classes = slim.groupBy("comp").agg(
        F.min("first").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "rid")).alias("best")
    )
    by_rid = slim.select("rid", "comp").join(classes, "comp").selectExpr("rid", "class_id", "class_size", "best.rid as keeper")
    rows = marks.select("doc_id", "_h", "rid").join(by_rid, "rid")
    return rows.selectExpr("doc_id", "_h", "class_id", "class_size", "rid = keeper and doc_id <=> class_id as kept")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, class_id, class_size, kept (whether it is the row of its class that stays)."""
    return classified(docs).select("doc_id", "class_id", "class_size", "kept")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each class, with all their columns.

    Rows of one doc_id whose texts differ only in what is no word are alike; the smallest hash stays.
    The rows that go are fewer than those that stay, so they are what the documents are joined with.
    """
    rows = classified(docs).groupBy("doc_id", "_h", "class_id", "kept").agg(F.count("*").alias("n"))
    least = rows.filter("kept").groupBy("doc_id", "class_id").agg(F.min("_h").alias("least"), F.count("*").alias("alike"))
    least = least.filter("alike > 1").selectExpr("doc_id as _id", "least")
    rows = rows.join(least, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    fate = written(rows.selectExpr("doc_id as _id", "_h as _k", "kept and (least is null or least = _h) as stays", "n").filter("not stays or n > 1"), "fate")
    full = docs.select(F.struct(*quoted(docs)).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"))
    same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k"))
    single = full.join(fate, same, "left_anti").select("_row.*")
    repeated = full.join(fate.filter("stays"), same, "left_semi").groupBy("_d", "_h").agg(F.first("_row").alias("_row"))
    return single.unionByName(repeated.select("_row.*"))
