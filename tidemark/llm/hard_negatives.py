"""Hard negatives: rotated one-bit codes bound every score, and only scores that the bounds leave open are computed.

Each vector is rotated by a fixed orthogonal matrix; its code is the signs of the rotated components, its
alignment the inner product with the code's unit vector, its residual the norm of the rest. An anchor's rotated
vector is rounded to PLANES bit planes, so the popcounts of code and planes give its product t with a
candidate's code vector up to the norm e of the rounding error. As the candidate is alignment * code + rest and the rest stands
at right angles to the code, Cauchy-Schwarz gives with certainty

    |score - alignment * t| <= alignment * e + residual * sqrt(|anchor|^2 - (|t| - e)^2)

with slack for rounding. Candidates whose interval cannot matter are left out; the others are scored in whole
numbers. Nothing is estimated in the result.

Two passes over the same blocks: the first finds each anchor's positives, the second the negatives of each of its
positives, those in the band from 0.8 times the positive's score to that score. The block's SEEDS most promising
candidates by estimate are scored first; an interval matters if it meets the band and reaches the k-th best
score in the band so far.
Blocks hold BLOCK_BYTES of vectors in the order they are read, so no label or id decides where a row goes, and
no vector is shuffled on its own; anchor blocks and candidate blocks meet in a grid of `lanes` by `rows` cells, which sends each
anchor block to `lanes` cells and each candidate block to `rows`, chosen so that neither side is sent much more often than
the other. A cell's result is at most k rows for a question; a limit on the rank
applies before the shuffle.

Edge cases: rows without id, label or vector, or with null, NaN or infinite components, take no part; shorter vectors
count as filled up with zeros; rows of an anchor's own id are never its positives or negatives; a repeated row is
a candidate each time, but one anchor; anchors of one id with other vectors or labels are anchors
of their own; ties go to the smaller id; a positive without a negative in its band gives no row, as does an
empty table. Sums that could pass 2^53 are added as whole numbers of any size and must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

SCALE, K = 256, 5
LOW = 80  # a negative has at least LOW hundredths of the positive's score
BLOCK_BYTES, ANCHOR_ROWS, CELL, PLANES, SEEDS, SEED = 2 << 20, 512, 64, 8, 32, 13
EXACT = 2.0**53
BLOCK = "ids binary, labels binary, vectors binary, codes binary, alignments binary, residuals binary, width int"
ANCHORS = "keys binary, ids binary, labels binary, vectors binary, scores binary, width int"


@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q


def codes_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code bits in 64-bit words, alignment, residual) of the rows of a matrix."""
    rows, width = vectors.shape
    rotated = vectors @ rotation(width) if width else vectors
    alignment = np.abs(rotated).sum(1) / math.sqrt(max(width, 1))
    rest = (rotated**2).sum(1) - alignment**2
    return _words(rotated >= 0), alignment, np.sqrt(np.maximum(rest, 0))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    padded = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


class Planes:
    """A rotated anchor in bit planes: products with code vectors by popcount, and their certain error."""

    def __init__(self, vector: np.ndarray):
        rotated = vector @ rotation(len(vector)) if len(vector) else vector
        self.width, self.norm2 = max(len(vector), 1), float((rotated**2).sum())
        low = rotated.min(initial=0)
        self.step = (rotated.max(initial=0) - low) / (2**PLANES - 1) or 1.0
        steps = np.rint((rotated - low) / self.step).astype(np.int64)
        rounded = low + self.step * steps
        self.low, self.total, self.error = low, rounded.sum(), float(np.sqrt(((rotated - rounded) ** 2).sum()))
        self.planes = [_words(((steps >> p) & 1).astype(bool)[None, :])[0] for p in range(PLANES)]

    def interval(self, codes: np.ndarray, alignments: np.ndarray, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Certain bounds of the scores with the candidates of these codes."""
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        sums = np.zeros(len(codes), np.int64)
        for p, plane in enumerate(self.planes):
            sums += np.bitwise_count(codes & plane).sum(1, dtype=np.int64) << p
        t = (2 * (self.low * ones + self.step * sums) - self.total) / math.sqrt(self.width)
        sure = np.maximum(np.abs(t) - self.error, 0)
        wide = alignments * self.error + residuals * np.sqrt(np.maximum(self.norm2 - sure**2, 0))
        middle = alignments * t
        slack = 1e-6 + 1e-9 * (alignments + residuals) * (math.sqrt(self.norm2) + 1)
        return middle - wide - slack, middle + wide + slack


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and floor(SCALE * x) of every component as doubles, of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    known = [F.col(c).isNotNull() for c in ("vec_id", "label", "embedding")]
    usable = vectors.filter(known[0] & known[1] & known[2] & F.forall("embedding", fine))
    noisy = F.col("vec_id") % 7 == 0
    label = F.when(noisy, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"))


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """(rows, width), shorter vectors filled up with zeros."""
    sizes = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables of `most` rows; the last one may have fewer."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - count)
            held.append(part)
            count, batch = count + part.num_rows, batch.slice(part.num_rows)
            if count == most:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _row(schema: str, *values) -> pa.RecordBatch:
    names = [field.split(" ")[0] for field in schema.split(", ")]
    kinds = [pa.int32() if field.endswith(" int") else pa.binary() for field in schema.split(", ")]
    cells = [v.tobytes() if isinstance(v, np.ndarray) else v for v in values]
    return pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cells, kinds, strict=True)], names)


def candidate_blocks(rows: DataFrame, width: int) -> DataFrame:
    """The rows in blocks with their codes, alignments and residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, max(1, BLOCK_BYTES // (8 * max(width, 1)))):
            m = matrix(table.column("v").combine_chunks(), width)
            columns = [table.column(c).to_numpy().astype("<i8") for c in ("vec_id", "label")]
            yield _row(BLOCK, *columns, m, *codes_of(m), width)

    return rows.mapInArrow(run, BLOCK)


def anchor_blocks(anchors: DataFrame, width: int) -> DataFrame:
    """Anchors (key, vec_id, label, v, scores of their positives) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, ANCHOR_ROWS):
            columns = [table.column(c).to_numpy().astype("<i8") for c in ("key", "vec_id", "label")]
            scores = matrix(table.column("scores").combine_chunks(), K + 1).astype("<i8")
            yield _row(ANCHORS, *columns, matrix(table.column("v").combine_chunks(), width), scores, width)

    return anchors.mapInArrow(run, ANCHORS)


def exact_scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whole-number inner products; of any size where doubles could not hold them."""
    if np.abs(vectors).max(initial=0) * np.abs(anchor).max(initial=0) * len(anchor) < EXACT:
        return (vectors @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in vectors], np.int64)


def first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the K highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:K]


def _kth(values: np.ndarray) -> float:
    return -math.inf if len(values) < K else float(np.partition(values, len(values) - K)[len(values) - K])


class Candidates:
    """A block of candidates as a task reads it."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), row["width"])
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(len(self.ids), -1)
        self.alignments, self.residuals = (np.frombuffer(row[c], "<f8") for c in ("alignments", "residuals"))

    def bounds(self, planes: Planes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return planes.interval(self.codes[at], self.alignments[at], self.residuals[at])

    def _open(self, vector: np.ndarray, at: np.ndarray, bands: list[tuple[int | None, int | None]]) -> np.ndarray:
        """Of the rows `at`, those whose interval leaves open whether they are among the K best of a band (None: no end)."""
        low, high = self.bounds(Planes(vector), at)
        open_ = np.zeros(len(at), bool)
        for least, most in bands:
            least, most = -math.inf if least is None else least / 100, math.inf if most is None else most
            within = np.flatnonzero((high >= least) & (low <= most))
            guess = (low[within] + high[within]) / 2
            seeds = at[within[np.argsort(-np.where(guess <= most, guess, 2 * most - guess), kind="stable")[:SEEDS]]]
            scores = exact_scores(self.vectors[seeds], vector).astype(np.float64)
            open_[within] |= high[within] >= _kth(scores[(scores >= least) & (scores <= most)])
        return at[open_]

    def positives(self, anchor: int, label: int, vector: np.ndarray, scores: np.ndarray) -> list[tuple]:
        """(0, id, score) of the K best rows of the anchor's label."""
        at = self._open(vector, np.flatnonzero((self.labels == label) & (self.ids != anchor)), [(None, None)])
        found = exact_scores(self.vectors[at], vector)
        return [(0, int(self.ids[at[i]]), int(found[i])) for i in first(self.ids[at], found)]

    def negatives(self, anchor: int, label: int, vector: np.ndarray, scores: np.ndarray) -> list[tuple]:
        """(place of the positive, id, score) of the K best rows of other labels in each positive's band.

        `scores` holds the number of positives and then their scores.
        """
        known = scores[1 : 1 + int(scores[0])].tolist()
        at = self._open(vector, np.flatnonzero((self.labels != label) & (self.ids != anchor)), [(LOW * s, s) for s in known])
        found = exact_scores(self.vectors[at], vector)
        out: list[tuple] = []
        hundredfold = 100 * (found if np.abs(found).max(initial=0) < 2**56 else found.astype(object))
        for place, score in enumerate(known):
            use = np.flatnonzero((hundredfold >= LOW * score) & (hundredfold <= 100 * score))
            out += [(place, int(self.ids[at[use[i]]]), int(found[use[i]])) for i in first(self.ids[at[use]], found[use])]
        return out


def grid(candidates: int, anchors: int) -> tuple[int, int]:
    """(lanes, rows) of cells of about CELL pairs of blocks: as square as the two sides allow."""
    cells = max(1, candidates * anchors // CELL)
    lanes = min(max(1, candidates), max(1, round(math.sqrt(cells * max(candidates, 1) / max(anchors, 1)))))
    return lanes, min(max(1, anchors), max(1, cells // lanes))


def _every(count: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)


def in_cells(blocks: DataFrame, anchors: DataFrame, asks: str, counts: tuple[int, int]) -> DataFrame:
    """key, place, id, score: what `Candidates.<asks>` says of every anchor and every block of candidates."""
    lanes, rows = grid(*counts)
    dealt = lambda n: F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(n)).cast("int")
    here = blocks.select("*", dealt(lanes).alias("lane")).select("*", _every(rows, "row"))
    there = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], dealt(rows).alias("row")).select("*", _every(lanes, "lane"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "place", "id", "score"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                block = Candidates(row)
                keys, ids, labels = (np.frombuffer(row[f"a_{c}"], "<i8") for c in ("keys", "ids", "labels"))
                vectors = np.frombuffer(row["a_vectors"], "<f8").reshape(len(ids), row["a_width"])
                scores = np.frombuffer(row["a_scores"], "<i8").reshape(len(ids), K + 1)
                found = [
                    (key, *answer)
                    for key, anchor, label, vector, known in zip(keys.tolist(), ids.tolist(), labels.tolist(), vectors, scores, strict=True)
                    for answer in getattr(block, asks)(anchor, label, vector, known)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    return here.join(there, ["lane", "row"]).drop("lane", "row").mapInArrow(run, "key long, place long, id long, score long")


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K)


def hard_negatives(vectors: DataFrame, modulus: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors whose vec_id the modulus divides."""
    rows = quantised(vectors)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    blocks = written(candidate_blocks(rows, width), "negatives-blocks")
    asked = rows.filter(F.col("vec_id") % modulus == 0).dropDuplicates()
    anchors = written(asked.withColumn("key", F.monotonically_increasing_id()), "negatives-anchors")
    unknown = anchors.withColumn("scores", F.array().cast("array<double>"))
    counts = blocks.count(), -(-anchors.count() // ANCHOR_ROWS)
    packed = written(anchor_blocks(unknown, width), "negatives-asked")
    positives = written(_ranked(in_cells(blocks, packed, "positives", counts)), "negatives-positives")
    known = positives.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("of"))
    scores = F.concat(F.array(F.size("of").cast("double")), F.transform("of.score", lambda s: s.cast("double")))
    with_scores = written(anchor_blocks(anchors.join(known.select("key", scores.alias("scores")), "key"), width), "negatives-answered")
    negatives = _ranked(in_cells(blocks, with_scores, "negatives", counts))
    pairs = positives.select("key", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        negatives.select("key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["key", "place"])
        .join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def oracle_sql(modulus: int = 100) -> str:
    """The same in SQL, by brute force."""
    product = "list_sum(list_transform(list_zip(a.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint"
    return f"""
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), anchors as (
  select row_number() over () as key, * from (select distinct vec_id, label, v from whole where vec_id % {modulus} = 0)
), scored as (
  select a.key, a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same, {product} as score
  from anchors a, whole c where a.vec_id <> c.vec_id
), positives as (
  select key, anchor_id, id as positive_id, score as positive_score,
    row_number() over (partition by key order by score desc, id) as place
  from scored where same qualify place <= {K}
), negatives as (
  select p.*, n.id as negative_id, n.score as negative_score,
    (row_number() over (partition by p.key, p.place order by n.score desc, n.id))::int as rank
  from positives p join scored n on n.key = p.key and not n.same
    and {LOW} * p.positive_score <= 100 * n.score and n.score <= p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= {K}
"""
