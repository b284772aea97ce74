"""Registration month by payment month: the cohort figures of all months from one pass over each table.

Registrations and payments are brought to one row per customer and month before they meet, so what is
joined is bounded by the calendar for each customer, however many rows the customer has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.constants import BUSINESS_ZONE
from tidemark.functions.figures import exprs
from tidemark.functions.month import MonthWindow, local_day
from tidemark.operators.sales import IS_FIRST_PAID


def _month(column: str, zone: str) -> str:
    return f"trunc({local_day(column, zone)}, 'MM')"


def cohort_triangle(registrations: DataFrame, purchases: DataFrame, zone: str = BUSINESS_ZONE) -> DataFrame:
    """Distinct customers per `registered_month` and `payment_month` (first days, local).

    Customers with a first payment in the one month and a registration in the other: `bought`,
    `claimed` as for `month_buyers`, `paid` whatever the amount. `newly_paid` are those of `paid` who
    have no earlier registration; each customer is in one of them per payment month, so they can be summed up.
    """
    registered = (
        registrations.where("id is not null and created_at is not null")
        .groupBy(*exprs("id as customer_id"))
        .agg(*exprs(f"collect_set({_month('created_at', zone)}) as months"))
    )
    buyers = (
        purchases.where(f"{IS_FIRST_PAID} and purchased_at is not null")
        .groupBy("customer_id", *exprs(f"{_month('purchased_at', zone)} as payment_month"))
        .agg(
            *exprs(
                "coalesce(bool_or(amount > 0), false) as bought",
                "coalesce(bool_or(amount > 0 and purchased_at >= claimed_at), false) as claimed",
            )
        )
    )
    cells = buyers.join(registered, "customer_id").selectExpr(
        "payment_month", "bought", "claimed", "array_min(months) as first_month", "explode(months) as registered_month"
    )
    return cells.groupBy("registered_month", "payment_month").agg(
        *exprs(
            "count_if(bought) as bought",
            "count_if(claimed) as claimed",
            "count(*) as paid",
            "count_if(registered_month = first_month) as newly_paid",
        )
    )


def month_of_triangle(triangle: DataFrame, window: MonthWindow) -> DataFrame:
    """One row of a month's `bought`, `claimed` and `earlier`: what `cohort_counts` gives for that month alone."""
    month = f"date'{window.first_day}'"
    same = f"registered_month = {month}"
    return triangle.where(f"payment_month = {month} and registered_month <= {month}").selectExpr(
        f"coalesce(sum(if({same}, bought, 0L)), 0L) as bought",
        f"coalesce(sum(if({same}, claimed, 0L)), 0L) as claimed",
        f"coalesce(sum(if({same}, 0L, newly_paid)), 0L) as earlier",
    )
