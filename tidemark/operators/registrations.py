"""Newly registered users and leads (NRU)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.figures import exprs
from tidemark.functions.month import MonthWindow, between, monday, week_of_month
from tidemark.sources.tables import Tables


def nru(tables: Tables) -> DataFrame:
    """Users and leads as one bag: `id`, `created_at`. An id in both tables is two rows."""
    return tables.users.select("id", "created_at").unionByName(
        tables.user_leads.select("id", "created_at")
    )


def nru_with_calls(tables: Tables) -> DataFrame:
    """Users once per call they had (so none without a call), and every lead once.

    A user with very many calls is a skewed join partition, which adaptive execution splits.
    """
    calls = tables.user_calls.selectExpr("user_id as id")
    users = tables.users.select("id", "created_at")
    return calls.join(users, "id").unionByName(tables.user_leads.select("id", "created_at"))


def nru_call_weights(tables: Tables, first: MonthWindow, last: MonthWindow) -> DataFrame:
    """`nru_with_calls` from month `first` to `last`, with `weight` rows counted, not repeated.

    Calls are cut down to the span's users, then counted per user, so a user with very
    many calls is one row in the join.
    """
    in_span = between("created_at", first.start, last.end)
    users = tables.users.where(in_span).select("id", "created_at")
    calls = (
        tables.user_calls.join(users.selectExpr("id as user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(*exprs("count(*) as weight"))
    )
    leads = tables.user_leads.where(in_span).selectExpr("id", "created_at", "1L as weight")
    return users.join(calls.withColumnRenamed("user_id", "id"), "id", "inner").unionByName(leads)


def nru_month_count(registrations: DataFrame, this: MonthWindow) -> DataFrame:
    """One row: rows with an id registered in the month and in the month before."""
    last = this.previous()
    return registrations.where(between("created_at", last.start, this.end)).selectExpr(
        f"count(if({this.contains('created_at')}, id, null)) as total_nru_this_month",
        f"count(if({last.contains('created_at')}, id, null)) as total_nru_last_month",
    )


def nru_by_week(registrations: DataFrame, window: MonthWindow) -> DataFrame:
    """The month's registrations with ISO week, that week's Monday and week of month."""
    day = window.local_day("created_at")
    return registrations.where(window.contains("created_at")).selectExpr(
        "id",
        "created_at",
        f"weekofyear({day}) as isoweek",
        f"{monday(day)} as first_day_of_week",
        f"{week_of_month(day)} as week",
    )


def nru_before_month(registrations: DataFrame, window: MonthWindow) -> DataFrame:
    """All registrations before the month, with their ISO week."""
    return registrations.where(window.is_after("created_at")).selectExpr(
        "id", "created_at", f"weekofyear({window.local_day('created_at')}) as isoweek"
    )
