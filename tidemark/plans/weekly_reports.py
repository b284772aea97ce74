"""Weekly reports per team member."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.month import MonthWindow
from tidemark.operators.members import (
    team_members,
    weekly_member_metrics,
    weekly_new_sale_totals,
    weekly_upsell_totals,
)
from tidemark.sources.tables import Tables


def weekly_new_sales_by_member(
    tables: Tables, month: MonthWindow, role: str | None = None, *more_roles: str
) -> DataFrame:
    """Orders and income per member and week of the month; roles limit the members to those with all of them."""
    admins = team_members(tables.admins, role, *more_roles)
    purchases = tables.within("purchased_packages", "purchased_at", month)
    return weekly_member_metrics(weekly_new_sale_totals(purchases, admins, month))


def weekly_upsells_by_member(
    tables: Tables, month: MonthWindow, role: str | None = None, *more_roles: str
) -> DataFrame:
    """Orders and income per member and week of the month; roles limit the members to those with all of them."""
    admins = team_members(tables.admins, role, *more_roles)
    purchases = tables.within("purchased_packages", "purchased_at", month)
    return weekly_member_metrics(
        weekly_upsell_totals(purchases, tables.packages, admins, month)
    )
