"""Month bounds, weeks and number text."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.build import purchase, tables
from tidemark import MonthWindow
from tidemark.functions.figures import grouped_whole, ratio, ratio_or_zero, side_by_side
from tidemark.functions.month import monday, week_of_month
from tidemark.operators.weeks import month_week_calendar, months_of
from tidemark.plans.new_sale_reports import new_sale_average
from tidemark.plans.weekly_reports import weekly_new_sales_by_member


@pytest.mark.parametrize(
    ("month", "start", "end"),
    [
        (2, datetime(2022, 1, 31, 17), datetime(2022, 2, 28, 17)),
        (3, datetime(2022, 2, 28, 17), datetime(2022, 3, 31, 17)),
        (7, datetime(2022, 6, 30, 17), datetime(2022, 7, 31, 17)),
        (12, datetime(2022, 11, 30, 17), datetime(2022, 12, 31, 17)),
    ],
)
def test_bounds_are_local_midnights(month, start, end):
    window = MonthWindow(2022, month)
    assert (window.start, window.end) == (start, end)
    assert window.previous().end == start
    assert window.next().start == end


def test_a_zone_with_summer_time():
    window = MonthWindow(2022, 3, "Europe/Berlin")
    assert window.start == datetime(2022, 2, 28, 23)
    assert window.end == datetime(2022, 3, 31, 22)


@pytest.mark.parametrize("month", [2, 3, 6, 7])
def test_month_edges(spark, month):
    """One purchase in the last microsecond of the month before, one at its start, and so
    on at the end: only two are inside."""
    window = MonthWindow(2022, month)
    tick = timedelta(microseconds=1)
    moments = [window.start - tick, window.start, window.end - tick, window.end]
    t = tables(
        spark,
        purchased_packages=[purchase(i, m.isoformat(), i) for i, m in enumerate(moments, 1)],
        admins=[(1, "Lan")],
    )
    assert new_sale_average(t, window).first()["total_count"] == 2
    weekly = {(r.week, r.type): r.value for r in weekly_new_sales_by_member(t, window).collect()}
    # The weekly report drops the last microsecond.
    assert weekly[("total_order", "order")] == 1


def test_a_session_zone_does_not_matter(spark):
    window = MonthWindow(2022, 3)
    t = tables(
        spark,
        purchased_packages=[purchase(1, "2022-02-28T17:00:00"), purchase(2, "2022-03-31T17:00:00")],
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert new_sale_average(t, window).first()["total_count"] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_week_of_month_equals_the_calendar_ordinal(spark):
    """For every day of eight years, with ISO weeks 52 and 53 at year ends."""
    days = spark.range(8 * 365 + 2).select(
        F.date_add(F.lit(date(2015, 1, 1)), F.col("id").cast("int")).alias("day")
    )
    calendar = month_week_calendar(
        days.select(F.trunc("day", "MM").alias("month_start")).distinct()
    )
    joined = days.selectExpr(
        "trunc(day, 'MM') as month_start",
        f"{monday('day')} as first_day_of_week",
        f"{week_of_month('day')} as by_rule",
        "weekofyear(day) as iso",
    ).join(calendar, ["month_start", "first_day_of_week"], "left")
    assert joined.where("not (by_rule <=> week) or not (iso <=> isoweek)").count() == 0
    # The reports look the week up by its ISO number, which is unique within a month.
    assert calendar.groupBy("month_start", "isoweek").count().where("count > 1").count() == 0


def test_calendar_with_the_next_first_day(spark):
    months = spark.sql("select date'2022-07-01' as month_start")
    assert month_week_calendar(months).count() == 5
    extended = month_week_calendar(months, with_next_first_day=True).orderBy("week").collect()
    assert [r.week for r in extended] == [1, 2, 3, 4, 5, 6]
    assert extended[-1].first_day_of_week == date(2022, 8, 1)
    assert [r.isoweek for r in extended] == [26, 27, 28, 29, 30, 31]


def test_months_of_are_local(spark):
    moments = ["2022-04-30T16:59:59", "2022-06-30T17:00:00", "2022-08-31T16:00:00", "2022-08-31T18:00:00"]
    t = tables(spark, purchased_packages=[purchase(i, at) for i, at in enumerate(moments)])
    months = months_of(t.purchased_packages, "purchased_at").orderBy("month_start").collect()
    assert [r[0] for r in months] == [date(2022, m, 1) for m in (4, 7, 8, 9)]


def test_number_text_rounds_half_to_even(spark):
    texts = spark.sql(
        "select " + ", ".join(grouped_whole(v) for v in ("2.5d", "3.5d", "1234567.4d", "null"))
    ).first()
    assert tuple(texts) == ("2.", "4.", "1,234,567.", None)


def test_ratios(spark):
    row = spark.sql(
        f"select {ratio('null', '0')}, {ratio_or_zero('3', '0')}, {ratio_or_zero('null', '2')},"
        f" {ratio_or_zero('1', '4')}"
    ).first()
    assert tuple(row) == (None, 0.0, 0.0, 0.25)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        spark.sql(f"select {ratio('1', '0')}").first()


def test_side_by_side_keeps_nulls_and_zeros(spark):
    row = side_by_side(
        spark.sql("select 0L as a, cast(null as double) as b"), spark.sql("select 2.5d as c")
    ).first()
    assert row.asDict() == {"a": 0, "b": None, "c": 2.5}
