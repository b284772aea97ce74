"""Buyers among the registered: who paid first in a month, and when they registered."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.figures import exprs
from tidemark.functions.month import MonthWindow
from tidemark.operators.sales import IS_FIRST_PAID


def month_buyers(purchases: DataFrame, window: MonthWindow) -> DataFrame:
    """Customers with a first payment in the month, one row each.

    `paid`: for more than nothing; `claimed`: such a payment not before its claim;
    `orders`, `income`: over such payments.
    """
    return (
        purchases.where(f"{IS_FIRST_PAID} and {window.contains('purchased_at')}")
        .groupBy("customer_id")
        .agg(
            *exprs(
                "coalesce(bool_or(amount > 0), false) as paid",
                "coalesce(bool_or(amount > 0 and purchased_at >= claimed_at), false) as claimed",
                "count(if(amount > 0, id, null)) as orders",
                "sum(if(amount > 0, local_amount, null)) as income",
            )
        )
    )


def cohort_counts(registrations: DataFrame, buyers: DataFrame, window: MonthWindow) -> DataFrame:
    """One row of distinct customers among the month's buyers.

    `bought` and `claimed`: registered in the same month; `earlier`: registered before
    it, and here a payment of nothing counts too. The registrations are cut down to the
    buyers first; then both sides are one row per customer, and one join decides all
    three instead of a distinct count each.
    """
    registered = (
        registrations.where(window.next().is_after("created_at"))
        .join(buyers.selectExpr("customer_id as id"), "id", "left_semi")
        .groupBy("id")
        .agg(
            *exprs(
                f"bool_or({window.contains('created_at')}) as in_month",
                f"bool_or({window.is_after('created_at')}) as before",
            )
        )
        .withColumnRenamed("id", "customer_id")
    )
    return registered.join(buyers, "customer_id", "inner").selectExpr(
        "count_if(in_month and paid) as bought",
        "count_if(in_month and claimed) as claimed",
        "count_if(before) as earlier",
    )


def cohort_sales(registrations: DataFrame, buyers: DataFrame, window: MonthWindow) -> DataFrame:
    """One row: all the month's new sales (`total_count`, `total_amount`) and, of their
    customers, the ones registered in the same month (`bought`, `claimed`)."""
    cohort = (
        registrations.where(window.contains("created_at"))
        .selectExpr("id as customer_id", "true as registered")
        .distinct()
    )
    return (
        buyers.where("paid")
        .join(cohort, "customer_id", "left")
        .selectExpr(
            "coalesce(sum(orders), 0L) as total_count",
            "sum(income) as total_amount",
            "count_if(registered) as bought",
            "count_if(registered and claimed) as claimed",
        )
    )


def cohort_sales_and_weight(
    registered: DataFrame, buyers: DataFrame, window: MonthWindow, this: MonthWindow
) -> DataFrame:
    """As `cohort_sales`, and `nru`, the weight of the rows registered in month `this`.

    `registered` has `id`, `created_at`, `weight`; it is read once and feeds both figures.
    """
    per_id = (
        registered.where("id is not null")
        .groupBy("id")
        .agg(
            *exprs(
                f"bool_or({window.contains('created_at')}) as registered",
                f"sum(if({this.contains('created_at')}, weight, 0L)) as nru",
            )
        )
        .withColumnRenamed("id", "customer_id")
    )
    return (
        buyers.where("paid")
        .join(per_id, "customer_id", "full")
        .selectExpr(
            "coalesce(sum(orders), 0L) as total_count",
            "sum(income) as total_amount",
            "count_if(registered and paid) as bought",
            "count_if(registered and paid and claimed) as claimed",
            "coalesce(sum(nru), 0L) as nru",
        )
    )
