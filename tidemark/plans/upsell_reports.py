"""Reports on upsells: averages, renewal counts and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.figures import ratio, ratio_or_zero, side_by_side
from tidemark.functions.month import MonthWindow
from tidemark.operators.renewal_summary import renewal_counts
from tidemark.operators.renewals import expired_user_counts
from tidemark.operators.sales import average_order, upsell_totals
from tidemark.sources.tables import Tables


def upsell_average(tables: Tables, month: MonthWindow) -> DataFrame:
    """The month's upsells: count, revenue, average order."""
    totals = upsell_totals(tables.within("purchased_packages", "purchased_at", month), tables.packages, month)
    return average_order(totals, "net_upsale_average").withColumnRenamed(
        "total_count", "number_upsale"
    )


def expiring_user_count(tables: Tables, **months: MonthWindow) -> DataFrame:
    """One row: users who expire in each named month; the months must be given in order."""
    return renewal_counts(tables.user_inventories, **months)


def renewer_counts(tables: Tables, month: MonthWindow, with_back: bool = True) -> DataFrame:
    """One row: users who renew early, renew on the day, or come back in the month."""
    return renewal_counts(tables.user_inventories, tables.purchased_packages, month, with_back)


def upsell_renewal_counts(tables: Tables, month: MonthWindow) -> DataFrame:
    """Users who expire in the month, renew early, renew on the day, or come back in it."""
    counts = renewal_counts(tables.user_inventories, tables.purchased_packages, month, expiring=month)
    return counts.selectExpr(
        "expiring as user_expired_this_month",
        "early as number_upsale_before_time",
        "on_time as number_upsale_on_time",
        "back as number_expired_ago_upsale_this_month",
    )


def upsell_rates(counts: DataFrame) -> DataFrame:
    """Add to the renewal counts their percentage, without and with users won back."""
    renewed = "number_upsale_on_time + number_upsale_before_time"
    due = "user_expired_this_month + number_upsale_before_time"
    back = "number_expired_ago_upsale_this_month"
    return counts.selectExpr(
        "*",
        f"{ratio(renewed, due)} * 100 as upsale_rate",
        f"{ratio(f'{renewed} + {back}', f'{due} + {back}')} * 100 as upsale_rate_real",
    )


def upsell_forecast(tables: Tables, month: MonthWindow) -> DataFrame:
    """Last month's renewal rate (in percent, as it is defined) times this month's
    expiring users times last month's average upsell. Raises if last month has
    neither expiring users nor early renewers."""
    last = month.previous()
    row = side_by_side(
        renewal_counts(
            tables.user_inventories,
            tables.purchased_packages,
            last,
            with_back=False,
            expired_last=last,
            expired_this=month,
        ),
        upsell_totals(tables.within("purchased_packages", "purchased_at", last), tables.packages, last),
    )
    figures = average_order(row).selectExpr(
        f"{ratio('on_time + early', 'early + expired_last')} * 100 as rate",
        "expired_this as expired",
        "average",
    )
    return figures.selectExpr(
        "rate as upsale_rate_last_month",
        "expired as number_expired_this_month",
        "average as net_upsale_pre_month",
        "rate * expired as user_upsale_successfully",
        "rate * expired * average as predict_net_sale",
    )


def simple_renewal_rate(tables: Tables, month: MonthWindow) -> DataFrame:
    """Expired users of both months and the share of last month's who have an inventory."""
    counts = expired_user_counts(tables.user_inventories, tables.purchased_packages, month)
    rate = ratio_or_zero("matched_last_month", "expired_last_month")
    return counts.selectExpr("*", f"{rate} as rate_upsale_last_month")


def upsell_forecast_simple(tables: Tables, month: MonthWindow) -> DataFrame:
    """This month's expired users times last month's average upsell times the simple rate."""
    last = month.previous()
    totals = upsell_totals(tables.within("purchased_packages", "purchased_at", last), tables.packages, last)
    figures = side_by_side(simple_renewal_rate(tables, month), totals).selectExpr(
        "expired_this_month as expired",
        f"{ratio_or_zero('total_amount', 'total_count')} as average",
        "rate_upsale_last_month as rate",
    )
    return figures.selectExpr(
        "expired as user_expired_this_month",
        "average as average_this_month",
        "rate as rate_upsale_last_month",
        "expired * average * rate as real_net_sale_this_month",
    )
