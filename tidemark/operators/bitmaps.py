"""Exact distinct counts that can be kept, united and intersected: bitmaps of whole-number ids.

Ids are divided into buckets of 32,768; a bitmap is the 4 KB of one bucket for one group. Bitmaps are
built by an aggregate that merges within each task before the shuffle, so an id, a group or a bucket
with most rows costs a task no more than its bitmaps. They suit ids that are dense, such as serial
numbers: a bucket that holds a single id takes 4 KB too.

NULL ids are not counted; a group without other ids has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.functions.figures import exprs


def id_bitmaps(rows: DataFrame, id: str, by: Sequence[str] = ()) -> DataFrame:
    """`by`, `bucket`, `bits`: the distinct ids of each group. Each of `by` is a column or `expression as name`."""
    return (
        rows.where(f"{id} is not null")
        .groupBy(*exprs(*by, f"bitmap_bucket_number({id}) as bucket"))
        .agg(*exprs(f"bitmap_construct_agg(bitmap_bit_position({id})) as bits"))
    )


def united(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ids that are in any of the groups which `by` brings together."""
    return bitmaps.groupBy(*exprs(*by, "bucket")).agg(*exprs("bitmap_or_agg(bits) as bits"))


def counted(bitmaps: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The number of ids per group; one row without `by`."""
    return bitmaps.groupBy(*exprs(*by)).agg(*exprs(f"coalesce(sum(bitmap_count(bits)), 0L) as {name}"))


def counted_in_both(one: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """One row: the number of ids in both, two ungrouped bitmaps, by inclusion and exclusion per bucket."""
    per_bucket = one.selectExpr("bucket", "bits").unionByName(other.selectExpr("bucket", "bits"))
    parts = per_bucket.groupBy("bucket").agg(
        *exprs("sum(bitmap_count(bits)) as apart", "bitmap_count(bitmap_or_agg(bits)) as together")
    )
    return parts.selectExpr(f"coalesce(sum(apart - together), 0L) as {name}")
