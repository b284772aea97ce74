"""One row a user of a month's renewals, from two reads of the inventories.

The first read finds the users with an expiry or a start in question and makes a Bloom filter of
them; the second drops everybody else's rows before the first exchange. What passes is turned into
events, which merge by user, kind and bucket:

* `start`: how many packages began on a local day;
* `paid`: a local day with an active, paid expiry; `lapsed`: there is one before the month;
* `due`: an exact expiry in the months asked for: the first package by id and how many others
  began before it expires;
* `edge`: the latest expiry before these months, and whether there is one after them.

So a user with very many packages is one row per day or distinct expiry in every task before the
shuffle. Distinct expiries meet their predecessors within an hour, each hour by itself; then hours
and days, bounded by the calendar, come together per user. Users that only the filter let through
have nothing in the month and are not counted.

A user's *next starts* are the start times of all their packages but the one that started first:
what `lead` over the starts yields, as a set.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from tidemark.functions.figures import exprs
from tidemark.functions.month import MonthWindow, between, utc_literal
from tidemark.operators.membership import where_member
from tidemark.operators.renewals import IS_ACTIVE
from tidemark.operators.sales import IS_PAID

EXPIRY, START = "actual_expired_at", "original_started_at"
MONTH = 1_000_000_000  # of a bucket: above it the month's place, below it the hour


def _with_payment(rows: DataFrame, purchases: DataFrame, wanted: str) -> DataFrame:
    """Adds `is_paid`: the row is wanted and its purchase is paid.

    Rows that are not wanted get a key of their own that no purchase has, so they spread over the join's tasks.
    """
    paid = purchases.where(f"{IS_PAID} and mongo_id is not null").selectExpr("concat('=', mongo_id) as _paid")
    own = f"concat('-', xxhash64(id, user_id, {START}, {EXPIRY}))"
    keyed = rows.selectExpr("*", f"coalesce(if({wanted}, concat('=', purchased_package_id), null), {own}) as _key")
    joined = keyed.join(paid.distinct(), keyed["_key"] == paid["_paid"], "left")
    return joined.selectExpr(*rows.columns, "_paid is not null as is_paid")


def _event(kind: str, when: str, bucket: str = "null", x: str = "null") -> str:
    fields = f"'kind', '{kind}', 'bucket', bigint({bucket}), 'x', cast({x} as timestamp_ntz)"
    return f"if({when}, named_struct({fields}), null)"


def _day(window: MonthWindow, column: str) -> str:
    return f"unix_date({window.local_day(column)})"


def renewal_summary(
    inventories: DataFrame,
    purchases: DataFrame | None = None,
    renewed: MonthWindow | None = None,
    with_back: bool = True,
    **due: MonthWindow,
) -> DataFrame:
    """One row per user with something in the months.

    For month `renewed`: `paid_days` and `start_days` (days since 1970 of active, paid expiries and
    of next starts in it, unsorted), `early`, `on_time`, `back` (false unless `with_back`), see `renewers`.
    For each month named in `due`, given in order: whether the user expires in it, see `expiring_users`.
    """
    events, months = [], list(due.values())
    asked = []
    rows = inventories.select("id", "user_id", START, EXPIRY)
    if months:
        first, last = months[0], months[-1]
        in_span, after = between(EXPIRY, first.start, last.end), f"{EXPIRY} >= {utc_literal(last.end)}"
        month = " ".join(f"when {window.contains(EXPIRY)} then {i}" for i, window in enumerate(months))
        hours = f"unix_date(to_date({EXPIRY})) * 24 + hour({EXPIRY}) + {MONTH // 2}L"  # positive
        hour = f"(case {month} else {len(months)} end) * {MONTH}L + {hours}"
        events += [_event("due", in_span, hour, EXPIRY), _event("edge", f"{EXPIRY} is not null and not {in_span}")]
        asked.append(in_span)
    else:
        after, first = "false", None
    if renewed is not None:
        rows = inventories.select("id", "user_id", START, EXPIRY, "purchased_package_id", "package_type", "status")
        expires = f"({IS_ACTIVE} and {renewed.contains(EXPIRY)})"
        lapsed = f"({IS_ACTIVE} and {renewed.is_after(EXPIRY)})" if with_back else "false"
        asked += [expires, renewed.contains(START)]
    users = inventories.where(" or ".join(asked)).select("user_id")
    rows = where_member(rows, users, "user_id")
    if renewed is not None:
        rows = _with_payment(rows, purchases, f"{expires} or {lapsed}")
        events += [
            _event("start", renewed.next().is_after(START), _day(renewed, START)),
            _event("paid", f"is_paid and {expires}", _day(renewed, EXPIRY)),
            _event("lapsed", f"is_paid and {lapsed}"),
        ]
    unfolded = rows.selectExpr(
        "user_id", "id", f"{START} as start", EXPIRY, f"inline(filter(array({', '.join(events)}), e -> e is not null))"
    )
    merged = unfolded.groupBy("user_id", "kind", "bucket", "x").agg(
        *exprs(
            "count(*) as n",
            "min(if(kind = 'due', struct(id is null, id, start is null, start), null)).start as head_start",
            "count_if(kind = 'due' and start < x) as overlapping",
            f"max(if(kind = 'edge' and not ({after}), {EXPIRY}, null)) as before",
            f"bool_or(kind = 'edge' and ({after})) as later",
        )
    )
    hourly = "partition by user_id, kind, bucket order by x"
    beside = "overlapping > int(coalesce(head_start < x, false))"
    per_bucket = (
        merged.selectExpr("*", f"coalesce({beside} or head_start < lag(x) over ({hourly}), false) as bad")
        .groupBy("user_id", "kind", "bucket")
        .agg(
            *exprs(
                "sum(n) as n",
                "bool_or(bad) as bad",
                "min_by(head_start, x) as head_start",
                "min(x) as x",
                "max(x) as last",
                "max(before) as before",
                "bool_or(later) as later",
            )
        )
    )
    dues = f"struct(x, head_start, last, bad, int(bucket div {MONTH}L) as month)"
    per_user = per_bucket.groupBy("user_id").agg(
        *exprs(
            f"array_sort(collect_list(if(kind = 'due', {dues}, null))) as dues",
            "array_sort(collect_list(if(kind = 'start', struct(bucket as day, n), null))) as starts",
            "collect_list(if(kind = 'paid', bucket, null)) as paid_days",
            "bool_or(kind = 'lapsed') as lapsed",
            "max(before) as before",
            "bool_or(later) as later",
        )
    )
    columns = ["user_id"]
    if renewed is not None:
        in_month = f"s.day >= {(renewed.first_day - date(1970, 1, 1)).days}"
        per_user = per_user.selectExpr(
            "*",
            f"transform(filter(starts, (s, k) -> {in_month} and (k > 0 or s.n > 1)), s -> s.day) as start_days",
            "if(get(starts, 0).n > 1, get(starts, 0).day, get(starts, 1).day) as second_day",
        ).selectExpr(
            "*",
            "coalesce(array_max(paid_days) > second_day, false) as early",
            "arrays_overlap(paid_days, start_days) as on_time",
            "lapsed and size(start_days) > 0 as back",
        )
        columns += ["paid_days", "start_days", "early", "on_time", "back"]
    for i, name in enumerate(due):
        follows = "d.bad or coalesce(d.head_start < if(k = 0, before, get(dues, k - 1).last), false)"
        extended = f"exists(transform(dues, (d, k) -> d.month = {i} and ({follows})), v -> v)"
        ends = f"(not later and coalesce(get(dues, size(dues) - 1).month = {i}, false))"
        columns.append(f"{extended} or {ends} as {name}")
    return per_user.selectExpr(*columns)


def renewal_counts(
    inventories: DataFrame,
    purchases: DataFrame | None = None,
    renewed: MonthWindow | None = None,
    with_back: bool = True,
    **due: MonthWindow,
) -> DataFrame:
    """One row: of the summary, the users who are `early`, `on_time`, `back`, and expire in each named month."""
    summary = renewal_summary(inventories, purchases, renewed, with_back, **due)
    names = [*(["early", "on_time", "back"] if renewed is not None else []), *due]
    return summary.selectExpr(*[f"count_if({name}) as {name}" for name in names])
