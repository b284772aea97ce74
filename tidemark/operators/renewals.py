"""Renewal behaviour of users whose packages expire, inventory by inventory; `renewal_summary` has it per user."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.constants import ACTIVE_INVENTORY, RENEWABLE_PACKAGE_TYPE
from tidemark.functions.figures import exprs
from tidemark.functions.month import MonthWindow, between, utc_literal
from tidemark.operators.membership import where_member
from tidemark.operators.ordered import with_next
from tidemark.operators.sales import IS_PAID

IS_ACTIVE = f"package_type = {RENEWABLE_PACKAGE_TYPE} and status = {ACTIVE_INVENTORY}"


def next_by_expiry(inventories: DataFrame, order: str = "actual_expired_at") -> DataFrame:
    """Each inventory with expiry and start of the user's next one by expiry.

    `order` may name another expiry column; the new column is then `next_` and its name.
    """
    return with_next(
        inventories.select("id", "user_id", order, "original_started_at"),
        key="user_id",
        order=order,
        tie="id",
        leads={f"next_{order}": order, "next_ori_started_at": "original_started_at"},
    )


def next_by_start(inventories: DataFrame, order: str = "original_started_at") -> DataFrame:
    """Each inventory with the original start of the user's next one by `order`."""
    columns = dict.fromkeys(("id", "user_id", "original_started_at", order))
    return with_next(
        inventories.select(*columns),
        key="user_id",
        order=order,
        tie="id",
        leads={"next_ori_started_at": "original_started_at"},
    )


def expires_in(window: MonthWindow) -> str:
    """On rows of `next_by_expiry`: does this row make its user an expiring one?

    Either the next package, begun before this one ends, expires in the month; or there
    is no next expiry and this one is in the month.
    """
    extended = "actual_expired_at > next_ori_started_at"
    return (
        f"({extended} and {window.contains('next_actual_expired_at')}"
        f" or next_actual_expired_at is null and {window.contains('actual_expired_at')})"
    )


def expiring_users(with_next_rows: DataFrame, **windows: MonthWindow) -> DataFrame:
    """One row: distinct expiring users per named month, all from one pass."""
    flags = [f"bool_or({expires_in(window)}) as {name}" for name, window in windows.items()]
    per_user = with_next_rows.where("user_id is not null").groupBy("user_id").agg(*exprs(*flags))
    return per_user.selectExpr(*[f"count_if({name}) as {name}" for name in windows])


def with_paid_purchase(rows: DataFrame, purchases: DataFrame, how: str) -> DataFrame:
    """Rows whose purchase is paid. One purchase with very many inventories is a skewed join
    partition, which adaptive execution splits; nothing above the join needs its key."""
    paid = purchases.where(IS_PAID).selectExpr("mongo_id as purchased_package_id")
    return rows.join(paid, "purchased_package_id", how)


def active_expiries(
    inventories: DataFrame,
    purchases: DataFrame,
    first: MonthWindow,
    last: MonthWindow | None = None,
    how: str = "inner",
) -> DataFrame:
    """`user_id`, `actual_expired_at` of active, paid inventories that expire in the month,
    or from month `first` to month `last`.

    Pass `how="left_semi"` where only distinct users matter.
    """
    in_span = between("actual_expired_at", first.start, (last or first).end)
    rows = inventories.where(f"{IS_ACTIVE} and {in_span}")
    return with_paid_purchase(rows, purchases, how).select("user_id", "actual_expired_at")


def due_with_starts(inventories: DataFrame, purchases: DataFrame, window: MonthWindow) -> DataFrame:
    """Each active, paid expiry of the month with its user's next starts: `earlier_starts` on earlier
    local days (an early renewal) and `same_day_starts` (one on time).

    This is the join of expiries and starts by user and unequal days, each expiry standing for its pairs:
    starts are counted per user and day and summed up over the days, so neither side's rows meet the
    other's one by one. A user's first start is no next start; it is the earliest, so one less
    is counted from its day on.
    """
    expiry, start = "actual_expired_at", "original_started_at"
    due = inventories.where(f"{IS_ACTIVE} and user_id is not null and {window.contains(expiry)}")
    started = inventories.where(f"user_id is not null and {window.next().is_after(start)}").select("user_id", start)
    per_day = (
        where_member(started, due.select("user_id"), "user_id")
        .groupBy("user_id", *exprs(f"{window.local_day(start)} as day"))
        .agg(*exprs("count(*) as here"))
    )
    days = per_day.selectExpr("*", "false as is_due").unionByName(
        due.selectExpr("user_id", f"{window.local_day(expiry)} as day", "0L as here", "true as is_due").distinct()
    )
    summed = (
        days.groupBy("user_id", "day")
        .agg(*exprs("sum(here) as here", "bool_or(is_due) as is_due"))
        .selectExpr("*", "sum(here) over (partition by user_id order by day) as so_far")
        .where("is_due")
        .selectExpr(
            "user_id as _user",
            "day as _day",
            "greatest(so_far - here - 1, 0L) as earlier_starts",
            "if(so_far = here, greatest(here - 1, 0L), here) as same_day_starts",
        )
    )
    rows = with_paid_purchase(due, purchases, "left_semi").select("id", "user_id", expiry)
    same = f"user_id = _user and {window.local_day(expiry)} = _day"
    return rows.join(summed, exprs(same)[0]).drop("_user", "_day")


def expired_user_counts(
    inventories: DataFrame, purchases: DataFrame, this: MonthWindow
) -> DataFrame:
    """One row: distinct users with an active expiry in the month before and in the month.

    `matched_last_month` is how many of the former have any inventory with a next start
    column. Each has one, the expiring inventory itself, so no join is needed to tell.
    """
    last = this.previous()
    per_user = (
        active_expiries(inventories, purchases, last, this, "left_semi")
        .where("user_id is not null")
        .groupBy("user_id")
        .agg(
            *exprs(
                f"bool_or({last.contains('actual_expired_at')}) as in_last",
                f"bool_or({this.contains('actual_expired_at')}) as in_this",
            )
        )
    )
    return per_user.selectExpr(
        "count_if(in_last) as expired_last_month",
        "count_if(in_last) as matched_last_month",
        "count_if(in_this) as expired_this_month",
    )
