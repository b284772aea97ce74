"""Neighbour and position of rows in a per-key order, even where one key holds most rows.

A window partitioned by key alone puts all rows of a key into one task. So keys are cut
into slices of the order, each a window partition of its own. The cuts are a sample of
the rows' own positions (order value, then tie-breaker): CUTS_PER_TASK of them for each
shuffle partition, taken by hash, so that the same rows always give the same cuts. A key
that has MIN_CUTS of them or more is cut at all of them; others are far smaller than a
task's share and stay whole. Nothing depends on a fixed number of rows, and a single
timestamp is cut as well, by its tie-breakers.

What a slice has to know about its neighbours is one row per slice:

* `with_next`: the next slice's first row, read off the exchanged rows and joined to the slice's last row;
* `with_position`: the number of rows in earlier slices, placed first in the window and dropped after it.

Order and tie-breaker sort with NULLs last, everywhere in the same way: as the pairs
(is null, value). Rows equal in both sort by the values that are taken from them, so the
result does not depend on where the cuts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.figures import exprs

CUTS_PER_TASK = 8
MIN_CUTS = 4

_SLICE = "_slice"
_CARRIED = "_carried"


def _position(order: str, tie: str) -> str:
    return f"struct({order} is null, {order}, {tie} is null, {tie})"


def _ascending(*names: str) -> str:
    return ", ".join(f"{name} asc nulls last" for name in names)


def cuts_of(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """`_key`, `_cuts` (sorted positions), `_heads` (every `_step`-th of them) of keys to be cut.

    At most about CUTS_PER_TASK rows' positions per shuffle partition in all, so the table
    can be broadcast. Plans only; the sample is drawn when the result is.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.agg(F.count("*")).scalar()
    chance = F.expr(f"pmod(xxhash64({key}, {order}, {tie}), {1 << 31}L) / {1 << 31}d")
    sampled = df.where(chance * rows < CUTS_PER_TASK * tasks)
    cuts = sampled.groupBy(F.col(key).alias("_key")).agg(
        F.expr(f"array_sort(collect_set({_position(order, tie)}))").alias("_cuts")
    )
    stepped = cuts.where(f"size(_cuts) >= {MIN_CUTS}").selectExpr(
        "_key", "_cuts", "int(ceil(sqrt(size(_cuts)))) as _step"
    )
    heads = "transform(sequence(0, size(_cuts) - 1, _step), i -> _cuts[i])"
    return stepped.selectExpr("*", f"{heads} as _heads")


def _sliced(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Adds the row's slice: the number of its key's cuts up to it, NULL for keys left whole."""
    here = _position(order, tie)
    cuts = F.broadcast(cuts_of(df, key, order, tie))
    in_block = "slice(_cuts, (_block - 1) * _step + 1, _step)"
    number = f"if(_block = 0, 0, (_block - 1) * _step + size(filter({in_block}, c -> c <= {here})))"
    return (
        df.join(cuts, F.col(key).eqNullSafe(F.col("_key")), "left")
        .selectExpr("*", f"if(_cuts is null, null, size(filter(_heads, c -> c <= {here}))) as _block")
        .selectExpr(*df.columns, f"if(_cuts is null, null, {number}) as {_SLICE}")
    )


def with_next(df: DataFrame, key: str, order: str, tie: str, leads: dict[str, str]) -> DataFrame:
    """Add columns holding the next row's values, per key, by order (nulls last), then tie.

    `leads` maps each new column to the column it takes from the next row.
    """
    taken = sorted(set(leads.values()) - {order, tie})
    carries = (order, tie, *taken)
    # One exchange serves the window and the first row of each slice; the other columns are named
    # in both, so that neither prunes its copy of it.
    rows = _sliced(df, key, order, tie).repartition(key, _SLICE)
    others = [c for c in df.columns if c not in {key, *carries}]
    fields = ", ".join([f"{c} is null as no_{c}, {c} as {c}" for c in carries] + [f"{c} as {c}" for c in others])
    firsts = rows.groupBy(key, _SLICE).agg(
        *exprs(f"min(struct({fields})) as first", f"bool_or({_SLICE} is not null) as cut")
    )
    before = f"lag({_SLICE}) over (partition by {key} order by {_SLICE})"
    carried = (
        firsts.where("cut")
        .selectExpr(key, f"{before} as {_SLICE}", "first")
        .where(f"{_SLICE} is not null")
        .selectExpr(f"{key} as _key", f"{_SLICE} as _from", f"first as {_CARRIED}")
    )
    window = f"partition by {key}, {_SLICE} order by {_ascending(order, tie, *taken)}"
    columns = [f"lead({source}) over ({window}) as {name}" for name, source in leads.items()]
    led = rows.selectExpr("*", f"lead(true) over ({window}) is null as _last", *columns)
    # At most one carried row per cut, whose number is bounded by the tasks' number.
    joined = led.join(F.broadcast(carried), F.expr(f"_last and {key} <=> _key and {_SLICE} = _from"), "left")
    filled = [f"if(_last, {_CARRIED}.{source}, {name}) as {name}" for name, source in leads.items()]
    return joined.selectExpr(*df.columns, *filled)


def with_position(df: DataFrame, key: str, order: str, tie: str, name: str) -> DataFrame:
    """Add the row's 1-based position, per key, by order (nulls last), then tie."""
    rows = _sliced(df, key, order, tie)
    earlier = f"partition by {key} order by {_SLICE} rows between unbounded preceding and 1 preceding"
    carried = (
        rows.where(f"{_SLICE} is not null")
        .groupBy(key, _SLICE)
        .agg(F.count(F.lit(1)).alias("rows_here"))
        .selectExpr(key, _SLICE, f"sum(rows_here) over ({earlier}) as {_CARRIED}")
        .where(f"{_CARRIED} is not null")
    )
    stacked = rows.selectExpr("*", f"bigint(null) as {_CARRIED}").unionByName(
        carried, allowMissingColumns=True
    )
    running = (
        f"partition by {key}, {_SLICE} order by {_ascending(_CARRIED, order, tie)}"
        " rows between unbounded preceding and current row"
    )
    counted = stacked.selectExpr("*", f"sum(coalesce({_CARRIED}, 1L)) over ({running}) as {name}")
    return counted.where(f"{_CARRIED} is null").drop(_SLICE, _CARRIED)
