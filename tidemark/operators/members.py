"""Sales per team member and week of the month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import (
    INCOME_TYPE,
    ORDER_TYPE,
    TOTAL_AMOUNT_WEEK,
    TOTAL_ORDER_WEEK,
)
from tidemark.functions.figures import exprs, grouped_whole, ratio
from tidemark.functions.month import MonthWindow, monday, week_of_month
from tidemark.operators.sales import IS_NEW_SALE, IS_REPEAT_SALE, not_upgrades


def team_members(admins: DataFrame, role: str | None = None, *more_roles: str) -> DataFrame:
    """All members, or those whose `role_ids` array has all of the roles."""
    for wanted in (role, *more_roles):
        if wanted is not None:
            admins = admins.where(F.array_contains("role_ids", wanted))
    return admins


def _members(admins: DataFrame) -> DataFrame:
    return admins.select("admin_id", "name")


def _with_iso_week(sales: DataFrame, window: MonthWindow) -> DataFrame:
    return sales.selectExpr("*", f"weekofyear({window.local_day('purchased_at')}) as weekios")


def member_new_sales(purchases: DataFrame, admins: DataFrame, window: MonthWindow) -> DataFrame:
    """New sales made by a known member, with the member's name and the ISO week."""
    sales = purchases.where(f"{IS_NEW_SALE} and {window.contains_short('purchased_at')}")
    return _with_iso_week(sales.join(_members(admins), "admin_id"), window)


def member_upsells(
    purchases: DataFrame, packages: DataFrame, admins: DataFrame, window: MonthWindow
) -> DataFrame:
    """Upsells made by a known member, with package type, name and ISO week."""
    sales = purchases.where(f"{IS_REPEAT_SALE} and {window.contains_short('purchased_at')}")
    upsells = sales.join(not_upgrades(packages), "package_id")
    return _with_iso_week(upsells.join(_members(admins), "admin_id"), window)


def sales_with_week(sales: DataFrame, window: MonthWindow) -> DataFrame:
    """Add the week's Monday, ISO week and week of month of each member sale."""
    day = window.local_day("purchased_at")
    return sales.selectExpr(
        "*",
        f"{monday(day)} as first_day_of_week",
        f"weekofyear({day}) as isoweek",
        f"{week_of_month(day)} as week",
    )


def _counted(sales: DataFrame, window: MonthWindow, *keys: str) -> DataFrame:
    """`orders` and `income` per week and `keys`: counted before anything is joined."""
    week = f"{week_of_month(window.local_day('purchased_at'))} as week"
    return sales.groupBy(*keys, *exprs(week)).agg(
        *exprs("count(id) as orders", "sum(local_amount) as income")
    )


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*exprs("sum(orders) as orders", "sum(income) as income"))


def weekly_new_sale_totals(
    purchases: DataFrame, admins: DataFrame, window: MonthWindow
) -> DataFrame:
    """`name`, `week`, `orders`, `income`; members of one name are one group."""
    sales = purchases.where(f"{IS_NEW_SALE} and {window.contains_short('purchased_at')}")
    per_admin = _counted(sales, window, "admin_id")
    return _summed(per_admin.join(_members(admins), "admin_id", "inner"), "name", "week")


def weekly_upsell_totals(
    purchases: DataFrame, packages: DataFrame, admins: DataFrame, window: MonthWindow
) -> DataFrame:
    """`name`, `week`, `orders`, `income`; members of one name are one group."""
    sales = purchases.where(f"{IS_REPEAT_SALE} and {window.contains_short('purchased_at')}")
    per_package = _counted(sales, window, "admin_id", "package_id")
    upsells = per_package.join(not_upgrades(packages), "package_id", "inner")
    per_admin = _summed(upsells, "admin_id", "week")
    return _summed(per_admin.join(_members(admins), "admin_id", "inner"), "name", "week")


def member_month_summary(weekly: DataFrame) -> DataFrame:
    """Per name, the month's `order_count`, `total_amount` and their ratio `average`."""
    totals = weekly.groupBy("name").agg(
        *exprs("sum(orders) as order_count", "sum(income) as total_amount")
    )
    return totals.selectExpr("*", f"{ratio('total_amount', 'order_count')} as average")


def weekly_member_metrics(weekly: DataFrame) -> DataFrame:
    """Long form of the weekly totals: `name`, `week`, `type`, `value`, `average`.

    Per name: orders and income of each week, then of the month, all with the month's
    average order as text. A name has at most six weeks, so they fit in one array; the
    month's figures come from them and the sales are read once. A member without a name
    has no average.
    """
    per_name = weekly.groupBy("name").agg(
        *exprs(
            "collect_list(struct(week, orders, income)) as weeks",
            "sum(orders) as order_count",
            "sum(income) as total_amount",
        )
    )
    number = per_name.schema["total_amount"].dataType.simpleString()

    def line(week: str, kind: str, value: str) -> str:
        return (
            f"named_struct('week', string({week}), 'type', '{kind}',"
            f" 'value', cast({value} as {number}))"
        )

    lines = (
        f"concat(transform(weeks, w -> {line('w.week', ORDER_TYPE, 'w.orders')}),"
        f" transform(weeks, w -> {line('w.week', INCOME_TYPE, 'w.income')}),"
        f" array({line(repr(TOTAL_ORDER_WEEK), ORDER_TYPE, 'order_count')},"
        f" {line(repr(TOTAL_AMOUNT_WEEK), INCOME_TYPE, 'total_amount')}))"
    )
    average = f"if(name is null, null, {grouped_whole(ratio('total_amount', 'order_count'))})"
    return per_name.selectExpr("name", f"{average} as average", f"inline({lines})").select(
        "name", "week", "type", "value", "average"
    )
