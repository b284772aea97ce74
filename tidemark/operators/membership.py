"""A Bloom filter of keys, built by an aggregate and tested before anything is shuffled.

The filter is one row: an array of 64-bit words. It is built at MOST_WORDS words, of which only those
with a bit set are ever rows, then folded to the smallest power of two that leaves it at most a
quarter full. So a small month has a small filter, and none passes MOST_WORDS * 8 bytes (16 MB),
which bounds what reaches the driver and the tasks; a set too large for that only makes the filter
less selective. A key of the set always passes. What passes beside them must be of no consequence
to the caller, or be removed by it.

The filter is a scalar subquery: planning starts no job, and the scan that it guards drops rows below
the first exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.figures import exprs

MOST_WORDS = 1 << 21
PROBES = 3
SPARSE = 4  # places for each bit set


def _places(key: str, places: str) -> list[str]:
    return [f"pmod(xxhash64({key}, {probe}), {places})" for probe in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row: `size` in words (a power of two) and `bits`, an array of them."""
    places = keys.selectExpr(f"explode(array({', '.join(_places(key, f'{MOST_WORDS * 64}L'))})) as place")
    words = places.groupBy(*exprs("place div 64 as word")).agg(
        *exprs("bit_or(shiftleft(1L, int(place % 64))) as bits")
    )
    wanted = f"sum(bit_count(bits)) * {SPARSE} / 64"
    size = f"bigint(pow(2, ceil(log2(greatest(coalesce({wanted}, 1), 1)))))"
    whole = words.agg(
        *exprs(f"least({size}, {MOST_WORDS}L) as size", "collect_list(struct(word, bits)) as words")
    )
    none = "transform(sequence(0L, size - 1), w -> named_struct('word', w, 'bits', 0L))"
    folded = (
        whole.selectExpr("size", f"inline(concat(words, {none}))")
        .groupBy("size", *exprs("word % size as word"))
        .agg(*exprs("bit_or(bits) as bits"))
    )
    return folded.groupBy("size").agg(
        *exprs("transform(array_sort(collect_list(struct(word, bits))), w -> w.bits) as bits")
    )


def where_member(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the keys, and few others. NULL keys do not pass."""
    filters = bloom_filter(keys.where(f"{key} is not null"), key)
    found = filters.select(F.struct("size", "bits").alias("filter")).scalar()
    known = rows.where(f"{key} is not null").withColumn("_filter", found)
    tests = [
        f"getbit(get(_filter.bits, int({place} div 64)), int({place} % 64)) = 1"
        for place in _places(key, "(_filter.size * 64)")
    ]
    return known.where(" and ".join(tests)).drop("_filter")
