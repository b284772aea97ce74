"""Exact top-k by inner product of whole-number vectors: columnar branch and bound over blocks.

Candidates come in blocks in vertical layout: one row of memory per dimension. A block of queries and a stripe of
candidates add up products a group of dimensions at a time, the widest dimensions first, each group as large as all
before it. After a group a candidate stays only if, for some query of the tile, its partial sum plus the most that the
remaining dimensions can add (Cauchy-Schwarz on the remaining mass of the query and of the stripe's largest candidate)
reaches that query's k-th best score so far; survivors are compacted before the next group. A group that seldom
leaves anything out is tested now and then only. Bounds have slack for rounding, scores are exact, and equal scores are
never pruned: sums are added in the narrowest type that holds every partial sum (24 bits, 53 bits, whole numbers of any size).

A first k-th best per query comes from SEED_ROWS candidates at most (SEED_BYTES of them), which is the bound of what comes to
the driver and is broadcast. All other data meets in a grid of cells: queries are dealt to rows of the grid, which hold QUERY_ROWS
and QUERY_BYTES at most, candidates to lanes, in the order they are read, so no id decides where a row goes. A candidate is sent to each row,
a query to each lane, one by one, and lanes are so many that neither side is sent much more often than the other. In a task
a cell's queries stand before its candidates: the queries are held, the candidates pass by. A cell's result is at most k rows
a query, whose best k are kept.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows
without id; shorter vectors count as filled up with zeros; repeated rows are candidates each, but
no candidate of a query that has their id; a repeated query row is one query; an empty table gives
no rows. Components beyond 16 bits are sent as doubles. Sums that could pass 2^53 are added as whole numbers of any size and must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

K = 5
SCALE = 256
BLOCK_ROWS, QUERY_ROWS, SEED_ROWS = 512, 1 << 18, 2048
QUERY_BYTES, SEED_BYTES, LANES, LANE_ROWS = 32 << 20, 8 << 20, 64, 1 << 16
DIMENSIONS, TILE, STRIPE = 8, 128, 2048
IDLE, AGAIN = 8, 32  # a test that has left nothing out so often is made in every AGAIN-th tile
ANSWER_ROWS = 1 << 16
SINGLE, EXACT = 2.0**24, 2.0**53


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(SCALE * x) of every component as doubles, of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def matrix(values: pa.Array) -> np.ndarray:
    """(dimensions, rows), shorter vectors filled up with zeros."""
    sizes = np.diff(values.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), width).T)
    out = np.zeros((width, len(sizes)), flat.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), rows] = flat
    return out


def as_wide(m: np.ndarray, width: int) -> np.ndarray:
    """The first `width` dimensions, filled up with zeros."""
    return m[:width] if len(m) >= width else np.vstack((m, np.zeros((width - len(m), m.shape[1]), m.dtype)))


def below(bounds: np.ndarray, kind: type) -> np.ndarray:
    """As a column of this type, rounded down."""
    return np.nextafter(bounds.astype(kind), kind(-np.inf))[:, None]


class Best:
    """Queries and the k best candidates of each so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.queries, self.floors, self.k = ids, queries, np.array(floors, np.float64), k
        self.width = len(queries)
        self.cuts = [0]
        while self.cuts[-1] < self.width:
            self.cuts.append(min(self.width, max(DIMENSIONS, 2 * self.cuts[-1])))
        self.largest = float(max(queries.max(initial=0), -queries.min(initial=0))) if queries.size else 0.0
        self.found, self.scores = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.counts = np.zeros(len(ids), np.int64)
        self.order: np.ndarray | None = None
        self.idle, self.turn = dict.fromkeys(self.cuts, 0), 0

    def add(self, c_ids: np.ndarray, cands: np.ndarray) -> None:
        """A block of candidates, one column each."""
        if not len(self.ids) or not len(c_ids):
            return
        cands = as_wide(cands, self.width)
        if self.order is None:  # the widest dimensions first, as this block has them
            self.order = np.argsort(-np.einsum("ij,ij->i", cands, cands, dtype=np.float64), kind="stable")
            self.queries = self.queries[self.order]
            self.left = np.empty((len(self.cuts), len(self.ids)))
            for start in range(0, len(self.ids), STRIPE):
                self.left[:, start : start + STRIPE] = self._masses(self.queries[:, start : start + STRIPE])
        cands = cands[self.order]
        largest = float(max(cands.max(initial=0), -cands.min(initial=0))) if cands.size else 0.0
        if self.largest * largest * self.width >= EXACT:
            queries, cands = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (self.queries, cands))
            self._keep(*_whole_numbers(self.ids, queries, c_ids, cands, self.k))
            return
        for start in range(0, len(c_ids), STRIPE):
            self._stripe(c_ids[start : start + STRIPE], cands[:, start : start + STRIPE])

    def _masses(self, m: np.ndarray) -> np.ndarray:
        """(cuts, columns): what the dimensions from each cut on can add."""
        squares = m.astype(np.float64) ** 2
        return np.sqrt(np.array([squares[c:].sum(0) for c in self.cuts]))

    def _stripe(self, c_ids: np.ndarray, cands: np.ndarray) -> None:
        most = self._masses(cands).max(1)
        kind = np.float32 if self.left[0].max() * most[0] * (1 + 1e-9) < SINGLE else np.float64
        cands = cands.astype(kind)
        for tile in range(0, len(self.ids), TILE):
            of = slice(tile, tile + TILE)
            at, sums = self._sums(of, self.queries[:, of].astype(kind), cands, most, kind)
            if not len(at):
                continue
            least = below(self.floors[of], kind)
            rows = np.flatnonzero(sums.max(1) >= least[:, 0])
            if not len(rows):
                continue
            sums, least, own = sums[rows], least[rows], self.ids[of][rows]
            reached = np.flatnonzero(sums >= least)
            if len(reached) > 4 * self.k * len(rows) and len(at) > self.k:  # floors are too low to choose by
                sums[c_ids[at] == own[:, None]] = -np.inf
                kth = np.partition(sums, len(at) - self.k, axis=1)[:, len(at) - self.k]
                reached = np.flatnonzero(sums >= np.maximum(least, kth[:, None]))
            row, column = np.divmod(reached, len(at))
            ids = c_ids[at[column]]
            use = np.flatnonzero(ids != own[row])
            self._keep(tile + rows[row[use]], ids[use], sums.ravel()[reached[use]].astype(np.int64))

    def _sums(self, of: slice, queries: np.ndarray, cands: np.ndarray, most: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Places of the candidates that the bounds leave, and their scores with a tile of queries."""
        at = np.arange(cands.shape[1])
        sums = np.zeros((queries.shape[1], len(at)), kind) if not self.width else None
        self.turn += 1
        start = gone = 0  # dimensions that are added, and those that `cands` no longer has
        for g, cut in enumerate(self.cuts[1:], 1):
            if cut < self.width and self.idle[cut] >= IDLE and self.turn % AGAIN:
                continue
            part = queries[start:cut].T @ cands[start - gone : cut - gone]
            sums = part if sums is None else np.add(sums, part, out=sums)
            start = cut
            if cut < self.width:
                least = self.floors[of] - self.left[g, of] * most[g] * (1 + 1e-9) - 1e-6
                alive = np.flatnonzero((sums >= below(least, kind)).any(0))
                if len(alive) < 0.7 * len(at):
                    at, cands, sums, gone = at[alive], cands[cut - gone :, alive], sums[:, alive], cut
                    self.idle[cut] = 0
                    if not len(at):
                        break
                else:
                    self.idle[cut] += 1
        return at, sums

    def _keep(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes candidates in where they are among the k best; ties go to the smaller id."""
        if not len(places):
            return
        last, last_id = self.scores[places, -1], self.found[places, -1]
        use = (self.counts[places] < self.k) | (scores > last) | (scores == last) & (ids < last_id)
        of = np.unique(places[use])
        if not len(of):
            return
        had = np.arange(self.k) < self.counts[of, None]
        places = np.concatenate((np.repeat(of, self.counts[of]), places[use]))
        ids, scores = np.concatenate((self.found[of][had], ids[use])), np.concatenate((self.scores[of][had], scores[use]))
        order = np.lexsort((ids, -scores, places))
        starts = np.searchsorted(places[order], of)
        sizes = np.diff(np.append(starts, len(places)))
        ranks = np.arange(len(places)) - np.repeat(starts, sizes)
        order, ranks = order[ranks < self.k], ranks[ranks < self.k]
        self.found[places[order], ranks], self.scores[places[order], ranks] = ids[order], scores[order]
        self.counts[of] = np.minimum(sizes, self.k)
        full = of[self.counts[of] == self.k]
        self.floors[full] = np.maximum(self.floors[full], self.scores[full, -1])

    def answer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query places, candidate ids, scores): each query's best k, as far as they reach its floor."""
        use = (np.arange(self.k) < self.counts[:, None]) & (self.scores >= self.floors[:, None])
        return np.repeat(np.arange(len(self.ids)), use.sum(1)), self.found[use], self.scores[use]


def search(q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, cands: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, candidate ids, scores): each query's best k among the candidates, as far as they reach its floor."""
    best = Best(q_ids, queries, floors, k)
    best.add(c_ids, cands)
    return best.answer()


def _whole_numbers(q_ids, queries, c_ids, cands, k):
    places, ids, scores = [], [], []
    for place, own in enumerate(q_ids):
        use = np.flatnonzero(c_ids != own)
        found = sorted(((-sum(int(a) * int(b) for a, b in zip(queries[:, place], cands[:, c], strict=True)), int(c_ids[c])) for c in use))[:k]
        places += [place] * len(found)
        ids += [i for _, i in found]
        scores += [-s for s, _ in found]
    return np.array(places, np.int64), np.array(ids, np.int64), np.array(scores, np.int64)


def grid(total: int, asked: int, bytes_each: float) -> tuple[int, int]:
    """(lanes, rows) of cells: as few rows as can hold the queries, and LANES lanes, or so many that neither side is sent much more."""
    rows = max(1, -(-asked // QUERY_ROWS), math.ceil(asked * bytes_each / QUERY_BYTES))
    most = max(LANES, min(total * rows // max(asked, 1), total // LANE_ROWS))
    return max(1, min(-(-total // BLOCK_ROWS), most)), rows


def in_cells(queries: DataFrame, rows: DataFrame, shape: tuple[int, int], k: int) -> DataFrame:
    """query, query_id, vec_id, score: of every cell, the best k of each query that reach its floor."""
    lanes, across = shape
    dealt = lambda n: F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select("query", "vec_id", "v", "floor", dealt(across).alias("row")).withColumn("lane", every(lanes))
    cands = rows.select(F.lit(None).cast("long").alias("query"), "vec_id", "v", F.lit(None).cast("double").alias("floor"), dealt(lanes).alias("lane")).withColumn("row", every(across))
    step = lambda side: (F.col("lane") * across + F.col("row")).cast("long") * 2 + side  # noqa: E731  a cell's queries, then its candidates
    columns = ["query", "vec_id", "v", "floor"]
    both = asks.select(step(0).alias("step"), *columns).unionByName(cands.select(step(1).alias("step"), *columns))

    def told(held: list[pa.RecordBatch], best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is None:
            return
        keys = np.concatenate([b.column("query").to_numpy() for b in held])
        places, ids, scores = best.answer()
        for start in range(0, len(places), ANSWER_ROWS):
            of = slice(start, start + ANSWER_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[places[of]], best.ids[places[of]], ids[of], scores[of])], ["query", "query_id", "vec_id", "score"])

    def opened(held: list[pa.RecordBatch]) -> Best:
        blocks = [matrix(b.column("v")) for b in held]
        width = max(map(len, blocks))
        ids, floors = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "floor"))
        return Best(ids, np.concatenate([as_wide(m, width) for m in blocks], axis=1), floors, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = -1, [], None
        for batch in batches:
            steps = batch.column("step").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(steps)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                part, step_ = batch.slice(start, stop - start), int(steps[start])
                if step_ // 2 != cell:
                    yield from told(held, best)
                    cell, held, best = step_ // 2, [], None
                if step_ % 2 == 0:
                    held.append(part)
                elif held:
                    if best is None:
                        best = opened(held)
                        held = [b.select(["query"]) for b in held]
                    best.add(part.column("vec_id").to_numpy(), matrix(part.column("v")))
        yield from told(held, best)

    met = both.repartition(lanes * across, F.shiftright("step", 1)).sortWithinPartitions("step")
    return met.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, modulus: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id the modulus divides."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors), "topk")
    largest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    total, widths, most = rows.agg(F.count("*"), F.sum(F.size("v").cast("long")), largest).first()
    short = (most or 0) < 2**15
    rows = rows.select("vec_id", F.col("v").cast("array<short>" if short else "array<double>").alias("v"))
    bytes_each = (widths or 0) / max(total, 1) * (2 if short else 8)
    seeds = max(k + 1, min(SEED_ROWS, int(SEED_BYTES / max(bytes_each, 1))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(seeds).toArrow()
    seed = None
    if sample.num_rows:
        seed = spark.sparkContext.broadcast((sample.column("vec_id").to_numpy(), matrix(sample.column("v").combine_chunks())))

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            floors = np.full(len(ids), -np.inf)
            if len(ids):
                places, _, scores = search(ids, m, floors, *seed.value, k)
                counts = np.bincount(places, minlength=len(ids))
                lowest = np.full(len(ids), np.inf)
                np.minimum.at(lowest, places, scores.astype(np.float64))
                floors = np.where(counts == k, lowest, -np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "vec_id", "v")), pa.array(floors)], ["query", "vec_id", "v", "floor"])

    asked = rows.filter(F.col("vec_id") % modulus == 0).dropDuplicates(["vec_id", "v"]).select(F.monotonically_increasing_id().alias("query"), "vec_id", "v")
    kind = "short" if short else "double"
    queries = written(asked.mapInArrow(with_floor, f"query long, vec_id long, v array<{kind}>, floor double"), "topk-queries")
    found = in_cells(queries, rows, grid(total, queries.count(), bytes_each), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(modulus: int = 50, k: int = K) -> str:
    """The same in SQL, by brute force."""
    return f"""
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), queries as (
  select row_number() over () as n, * from (select distinct vec_id, v from whole where vec_id % {modulus} = 0)
), scored as (
  select q.n, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint as score
  from queries q, whole c where q.vec_id <> c.vec_id
)
select query_id, (row_number() over (partition by n order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= {k}
"""
