"""Mix sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating. They share 150 % of all
words by weight; no source gives more than twice its words, and what it cannot give is shared among
the others by weight.

Curriculum: training runs from 0 to 1. A source's weight changes along it by a line that its rank
fixes (falling, level or rising); the integral of that line is the share of the source's target
that training has asked for so far. A source's documents queue in the order of a hash of doc_id,
all once and then all again, and a document's place in the queue, put through the inverse of the
integral, is the position in training at which it is read. Documents are range-sorted by position.

The place in the queue is a running sum over a whole source, which no single task adds up: the
queue is cut by the first digits of the hash, the cuts' totals are summed first, and rows only
within a cut.

Edge cases: a null text has no words; a null source is a source of its own; a null doc_id hashes as
''; repeated rows queue one after the other; a document without words takes nothing and, in `mixed`,
is kept once. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, written

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)  # change of the weight from the middle of training to its end, relative
SHARE, MOST = 1.5, 2
CUT_DIGITS = 3  # 4,096 cuts of a source
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0))


def queued(docs: DataFrame) -> DataFrame:
    """Adds _source, _size, _hash, _cut to `_row`, the document."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = docs.select(F.struct(*quoted(docs)).alias("_row"), F.col("source").alias("_source"), words().alias("_size"), key.alias("_hash"))
    return out.withColumn("_cut", F.substring("_hash", 1, CUT_DIGITS))


def source_targets(totals: DataFrame) -> DataFrame:
    """From (_source, _words): adds _target and _slope. Sources are as many rows as the mix has sources."""
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("_rank") % len(values) + 1).cast("int"))
    ranked = totals.withColumn("_rank", rank).withColumn("_weight", pick(WEIGHTS)).withColumn("_slope", pick(SLOPES))
    ranked = ranked.withColumn("_fill", (MOST * F.col("_words")).cast("double") / F.col("_weight"))
    by_fill = Window.orderBy("_fill", "_rank")
    filled = ranked.selectExpr("*", "sum(_words) over () as _all").select(
        "*",
        (SHARE * F.col("_all").cast("double") - F.coalesce(F.sum(MOST * F.col("_words")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_left"),
        F.sum("_weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_open"),
    )
    # In this order a source is full if an equal level over it and all later ones would reach its limit.
    level = F.col("_left") / F.col("_open")
    full = level >= F.col("_fill")
    shared = F.max(F.when(~full, level)).over(Window.partitionBy())  # falls after the first source that is not full
    limit = (MOST * F.col("_words")).cast("double")
    target = F.when(full, limit).otherwise(F.least(limit, shared * F.col("_weight")))
    return filled.select("_source", "_words", target.alias("_target"), "_slope")


def placed(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """Adds _words, _target, _slope and _before, the words queued before the document, to `rows` of `queued`.

    `slim` has _source, _cut, _size of the same rows; it is read for the totals.
    """
    cuts = slim.groupBy("_source", "_cut").agg(F.sum("_size").alias("_n"))
    targets = source_targets(cuts.groupBy("_source").agg(F.sum("_n").alias("_words")))
    in_source = Window.partitionBy("_source").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.withColumn("_start", F.coalesce(F.sum("_n").over(in_source), F.lit(0))).drop("_n")
    facts = starts.alias("c").join(targets.alias("t"), F.col("c._source").eqNullSafe(F.col("t._source")))
    facts = facts.select(F.col("c._source").alias("_s"), F.col("_cut").alias("_c"), "_start", "_words", "_target", "_slope")
    in_cut = Window.partitionBy("_source", "_cut").orderBy("_hash", "_row.doc_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inner", F.coalesce(F.sum("_size").over(in_cut), F.lit(0)))
    joined = summed.join(facts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cut") == F.col("_c")))
    return joined.withColumn("_before", F.col("_start") + F.col("_inner")).drop("_start", "_inner", "_s", "_c")


def taken_of(epoch: int) -> Column:
    """Words that the mix takes from the document's epoch-th reading (0, 1)."""
    left = F.floor("_target") - F.col("_words") * epoch - F.col("_before")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), left))


def position(epoch: int) -> Column:
    """When in training, from 0 to 1, the middle of that reading is due."""
    middle = F.col("_words") * epoch + F.col("_before") + F.col("_size") / F.lit(2.0)
    share = F.least(F.lit(1.0), F.try_divide(middle, F.col("_target")))  # 1 where nothing is asked for
    flat = 1 - F.col("_slope")
    risen = (F.sqrt(flat * flat + 4 * F.col("_slope") * share) - flat) / (2 * F.col("_slope"))
    return F.when(F.col("_slope") == 0, share).otherwise(risen)


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, position_1, position_2 (null: not read), sorted by position."""
    slim = written(queued(docs.select("doc_id", "source", "text")).select(F.struct("_row.doc_id").alias("_row"), "_source", "_size", "_hash", "_cut", F.lit(0).alias("_tie")), "mix")
    out = placed(slim, slim).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (taken_of(0) + taken_of(1)).alias("taken"),
        *(F.when(taken_of(k) > 0, position(k)).alias(f"position_{k + 1}") for k in (0, 1)),
    )
    order = [F.col("position_1").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, whole and with all their columns, as often as the mix reads them, sorted by position.

    A reading that the target cuts short is kept if at least half of it is taken.
    """
    rows = queued(docs).withColumn("_tie", F.xxhash64("_row.text"))
    slim = written(queued(docs.select("doc_id", "source", "text")).groupBy("_source", "_cut").agg(F.sum("_size").alias("_size")), "mix")
    reads = [F.when((2 * taken_of(k) >= F.col("_size")) & ((F.col("_size") > 0) | F.lit(k == 0)), F.coalesce(position(k), F.lit(0.0))) for k in (0, 1)]
    out = placed(rows, slim).select("_row", F.explode(F.array_compact(F.array(*reads))).alias("_position"))
    return out.repartitionByRange("_position").sortWithinPartitions("_position").select("_row.*")


def oracle_sql() -> str:
    """The same in SQL."""
    pick = lambda values: "case rank % 3 " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"
    place = lambda k: f"least(1.0::double, (source_size * {k} + earlier + size / 2.0::double) / target)"
    taken = lambda k: f"greatest(0, least(size, floor(target)::bigint - source_size * {k} - earlier))"
    due = lambda k: f"case when {taken(k)} > 0 then case when slope = 0 then {place(k)} else (sqrt((1 - slope) * (1 - slope) + 4 * slope * {place(k)}) - (1 - slope)) / (2 * slope) end end"
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, row_number() over (order by source nulls last) - 1 as rank, sum(source_size) over ()::bigint as everything from totals
), weighed as (
  select *, ({pick(WEIGHTS)})::double as weight, ({pick(SLOPES)})::double as slope from ranked
), level as (
  select max((1.5::double * everything::double - coalesce(full_before, 0)::double) / open_weight) as level from (
    select *, 2 * source_size / weight as fill,
      sum(2 * source_size) over (order by 2 * source_size / weight, rank rows between unbounded preceding and 1 preceding) as full_before,
      sum(weight) over (order by 2 * source_size / weight, rank rows between current row and unbounded following) as open_weight
    from weighed
  ) where (1.5::double * everything::double - coalesce(full_before, 0)::double) / open_weight < fill
), targets as (
  select source, source_size, slope, least((2 * source_size)::double, coalesce(level * weight, (2 * source_size)::double)) as target
  from weighed, level
), queue as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, t.slope,
    coalesce(sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.doc_id, s.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as earlier
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, source, size, source_size, target, ({taken(0)} + {taken(1)})::bigint as taken, {due(0)} as position_1, {due(1)} as position_2
from queue
"""
