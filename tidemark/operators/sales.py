"""New sales (first payments) and upsells (later payments, upgrades aside)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.constants import FIRST_PAYMENT, PAID_STATUSES, UPGRADE_PACKAGE_TYPE
from tidemark.functions.figures import exprs, ratio
from tidemark.functions.month import MonthWindow

# Conditions on purchases.
IS_PAID = f"status in {PAID_STATUSES}"
IS_FIRST_PAID = f"paid_counter = {FIRST_PAYMENT} and {IS_PAID}"
IS_NEW_SALE = f"{IS_FIRST_PAID} and amount > 0"
# An upsell, if its package turns out not to be an upgrade.
IS_REPEAT_SALE = f"paid_counter > {FIRST_PAYMENT} and {IS_PAID} and amount > 0"


def not_upgrades(packages: DataFrame) -> DataFrame:
    """`package_id`, `package_type` of packages known not to be upgrades."""
    return packages.where(f"package_type <> {UPGRADE_PACKAGE_TYPE}").selectExpr(
        "mongo_id as package_id", "package_type"
    )


def new_sales(purchases: DataFrame, window: MonthWindow) -> DataFrame:
    return purchases.where(f"{IS_NEW_SALE} and {window.contains('purchased_at')}")


def repeat_sales(purchases: DataFrame, window: MonthWindow) -> DataFrame:
    return purchases.where(f"{IS_REPEAT_SALE} and {window.contains('purchased_at')}")


def upsells(purchases: DataFrame, packages: DataFrame, window: MonthWindow) -> DataFrame:
    """Upsell rows with their package type.

    Catalyst broadcasts `packages` if it is small; else adaptive execution splits the
    partition of a best-selling package.
    """
    return repeat_sales(purchases, window).join(not_upgrades(packages), "package_id")


def new_sale_totals(purchases: DataFrame, window: MonthWindow) -> DataFrame:
    """One row: `total_count`, `total_amount` (NULL without sales)."""
    return new_sales(purchases, window).selectExpr(
        "count(id) as total_count", "sum(local_amount) as total_amount"
    )


def upsell_totals(purchases: DataFrame, packages: DataFrame, window: MonthWindow) -> DataFrame:
    """One row: `total_count`, `total_amount` (NULL without sales).

    Sums per package come before the join, so a best-selling package is one row in it.
    """
    per_package = (
        repeat_sales(purchases, window)
        .groupBy("package_id")
        .agg(*exprs("count(id) as orders", "sum(local_amount) as income"))
    )
    return per_package.join(not_upgrades(packages), "package_id", "inner").selectExpr(
        "coalesce(sum(orders), 0L) as total_count", "sum(income) as total_amount"
    )


def average_order(totals: DataFrame, name: str = "average") -> DataFrame:
    """Add the average order; NULL without sales."""
    return totals.selectExpr("*", f"{ratio('total_amount', 'total_count')} as {name}")
