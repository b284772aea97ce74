"""Reports on new sales: averages, conversion and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.figures import ratio, ratio_or_zero, side_by_side
from tidemark.functions.month import MonthWindow
from tidemark.operators.cohorts import (
    cohort_counts,
    cohort_sales,
    cohort_sales_and_weight,
    month_buyers,
)
from tidemark.operators.registrations import nru, nru_by_week, nru_call_weights, nru_month_count
from tidemark.operators.sales import IS_NEW_SALE, average_order, new_sale_totals
from tidemark.sources.tables import Tables


def new_sale_average(tables: Tables, month: MonthWindow) -> DataFrame:
    """The month's new sales: count, revenue, average order."""
    return average_order(new_sale_totals(tables.within("purchased_packages", "purchased_at", month), month))


def new_sale_rate(tables: Tables, month: MonthWindow) -> DataFrame:
    """Buyers per claimed buyer in percent: of the month's registrations, and with
    earlier registrations who bought this month on both sides."""
    buyers = month_buyers(tables.within("purchased_packages", "purchased_at", month), month)
    return cohort_counts(nru(tables), buyers, month).selectExpr(
        f"{ratio_or_zero('bought', 'claimed')} * 100 as newsale_rate_in_month",
        f"{ratio_or_zero('earlier + bought', 'claimed + earlier')} * 100 as newsale_rate_real",
    )


def new_sale_forecast(tables: Tables, month: MonthWindow) -> DataFrame:
    """Last month's rate among claimed buyers (in percent, as it is defined) times this
    month's registrations with calls times last month's average order."""
    last = month.previous()
    registered = nru_call_weights(tables, last, month)
    buyers = month_buyers(tables.within("purchased_packages", "purchased_at", last), last)
    row = cohort_sales_and_weight(registered, buyers, last, month)
    figures = average_order(row).selectExpr(
        f"{ratio_or_zero('bought', 'claimed')} * 100 as rate", "nru", "average"
    )
    return figures.selectExpr(
        "rate as newsale_rate_last_month",
        "nru as total_nru_this_month",
        "average as average_new_sale_last_month",
        "rate * nru as total_nru_new_sale_success",
        "rate * nru * average as predict_money",
    )


def new_sale_forecast_by_nru(tables: Tables, month: MonthWindow) -> DataFrame:
    """Last month's buyers per registration times this month's registrations times last
    month's average order. Raises if nobody registered last month."""
    last = month.previous()
    registered = nru(tables)
    buyers = month_buyers(tables.within("purchased_packages", "purchased_at", last), last)
    row = side_by_side(
        cohort_sales(registered, buyers, last), nru_month_count(registered, month)
    )
    figures = average_order(row).selectExpr(
        f"{ratio('bought', 'total_nru_last_month')} as rate", "total_nru_this_month", "average"
    )
    return figures.selectExpr(
        "rate as rate_new_sale_last_month",
        "total_nru_this_month",
        "average as average_new_sale_last_month",
        "average * rate * total_nru_this_month as real_money",
    )


def nru_purchase_detail(tables: Tables, month: MonthWindow) -> DataFrame:
    """First payments, at any time, of the month's registrations, with the week of
    registration."""
    registered = nru_by_week(nru(tables), month).selectExpr(
        "id as nru_id", "created_at as nru_created_at", "isoweek", "first_day_of_week", "week"
    )
    sales = tables.purchased_packages.where(IS_NEW_SALE)
    return sales.join(registered, sales["customer_id"] == registered["nru_id"], "inner")
