"""Weeks of calendar months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import BUSINESS_ZONE
from tidemark.functions.figures import exprs
from tidemark.functions.month import local_day, monday


def months_of(df: DataFrame, column: str, zone: str = BUSINESS_ZONE) -> DataFrame:
    """First days (`month_start`) of the local months in which a column has moments.

    A UTC day lies in at most two local months, those of its first and last moment; so
    only these two are converted to local time, not every row.
    """
    per_day = (
        df.where(f"{column} is not null")
        .groupBy(F.expr(f"to_date({column}) as day"))
        .agg(*exprs(f"min({column}) as first", f"max({column}) as last"))
    )
    moments = per_day.selectExpr("explode(array(first, last)) as moment")
    return moments.selectExpr(f"trunc({local_day('moment', zone)}, 'MM') as month_start").distinct()


def month_week_calendar(months: DataFrame, with_next_first_day: bool = False) -> DataFrame:
    """Per month, its Monday-to-Sunday weeks: Monday, ISO week, number from 1.

    `with_next_first_day` extends each month by the next month's first day, which can
    add one more week.
    """
    final = "add_months(month_start, 1)" if with_next_first_day else "last_day(month_start)"
    days = months.selectExpr("month_start", f"explode(sequence(month_start, {final})) as day")
    mondays = days.selectExpr("month_start", f"{monday('day')} as first_day_of_week").distinct()
    return mondays.selectExpr(
        "month_start",
        "first_day_of_week",
        "weekofyear(first_day_of_week) as isoweek",
        "row_number() over (partition by month_start order by first_day_of_week) as week",
    )
