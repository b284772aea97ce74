"""Weekly member reports on tables written by hand."""

from dataclasses import replace

from tests.build import purchase, tables
from tidemark import MonthWindow
from tidemark.operators import members
from tidemark.plans import weekly_reports as reports

DECEMBER = MonthWindow(2021, 12)
JULY = MonthWindow(2022, 7)


def lines(df):
    return {(r.name, r.week, r.type): (r.value, r.average) for r in df.collect()}


def test_members_of_one_name_and_without_a_name(spark):
    at = "2022-07-04T00:00:00"
    t = tables(
        spark,
        admins=[(1, "Lan"), (2, "Lan"), (3, None)],
        purchased_packages=[
            purchase(1, at, local=2, admin=1),
            purchase(2, at, local=3, admin=2),
            purchase(3, at, local=10, admin=3),
            purchase(4, at, local=10, admin=None),
            purchase(5, at, local=10, admin=99),
        ],
    )
    assert lines(reports.weekly_new_sales_by_member(t, JULY)) == {
        ("Lan", "2", "order"): (2, "2."),
        ("Lan", "2", "income"): (5, "2."),
        ("Lan", "total_order", "order"): (2, "2."),
        ("Lan", "total_amount", "income"): (5, "2."),
        (None, "2", "order"): (1, None),
        (None, "2", "income"): (10, None),
        (None, "total_order", "order"): (1, None),
        (None, "total_amount", "income"): (10, None),
    }


def test_a_role_limits_the_members(spark):
    at = "2022-07-04T00:00:00"
    t = tables(spark, purchased_packages=[purchase(i, at, admin=i) for i in (1, 2, 3)])
    admins = spark.createDataFrame(
        [(1, "Lan", ["sale", "lead"]), (2, "Minh", ["support"]), (3, "Thu", None)],
        "admin_id bigint, name string, role_ids array<string>",
    )
    t = replace(t, admins=admins)
    assert {name for name, _, _ in lines(reports.weekly_new_sales_by_member(t, JULY))} == {
        "Lan", "Minh", "Thu",
    }
    limited = reports.weekly_new_sales_by_member(t, JULY, role="sale")
    assert {name for name, _, _ in lines(limited)} == {"Lan"}


def test_year_end_weeks(spark):
    """December 2021 ends in ISO week 52; January 2022 begins in it."""
    t = tables(
        spark,
        admins=[(1, "Lan")],
        purchased_packages=[
            purchase(1, "2021-12-31T16:00:00", local=1000),
            purchase(2, "2021-12-31T17:00:00", local=2000),
            purchase(3, "2022-01-03T00:00:00", local=4000),
        ],
    )
    december = lines(reports.weekly_new_sales_by_member(t, DECEMBER))
    assert december[("Lan", "5", "income")] == (1000, "1,000.")
    january = lines(reports.weekly_new_sales_by_member(t, DECEMBER.next()))
    assert january[("Lan", "1", "income")] == (2000, "3,000.")
    assert january[("Lan", "2", "income")] == (4000, "3,000.")
    rows = members.member_new_sales(t.purchased_packages, t.admins, DECEMBER.next())
    weeks = members.sales_with_week(rows, DECEMBER.next()).collect()
    assert sorted((r.id, r.weekios, r.isoweek, r.week) for r in weeks) == [(2, 52, 52, 1), (3, 1, 1, 2)]


def test_upsells_leave_out_upgrades(spark):
    at = "2022-07-04T00:00:00"
    t = tables(
        spark,
        admins=[(1, "Lan")],
        packages=[("plain", 1), ("upgrade", 4), ("untyped", None)],
        purchased_packages=[
            purchase(i, at, counter=2, package=package)
            for i, package in enumerate(("plain", "upgrade", "untyped", "plain"), 1)
        ],
    )
    result = lines(reports.weekly_upsells_by_member(t, JULY))
    assert result[("Lan", "total_order", "order")] == (2, "100.")
    rows = members.member_upsells(t.purchased_packages, t.packages, t.admins, JULY)
    assert {r.id for r in rows.collect()} == {1, 4}


def test_decimal_money(spark):
    t = tables(
        spark,
        admins=[(1, "Lan")],
        purchased_packages=[
            purchase(1, "2022-07-04T00:00:00", local=1),
            purchase(2, "2022-07-12T00:00:00", local=2),
        ],
    )
    priced = t.purchased_packages.withColumn(
        "local_amount", t.purchased_packages["local_amount"].cast("decimal(18,2)") + 0.25
    ).selectExpr("* except (local_amount)", "cast(local_amount as decimal(18,2)) as local_amount")
    weekly = members.weekly_new_sale_totals(priced, t.admins, JULY)
    result = lines(members.weekly_member_metrics(weekly))
    assert float(result[("Lan", "total_amount", "income")][0]) == 3.5
    assert float(result[("Lan", "total_order", "order")][0]) == 2.0
    assert result[("Lan", "2", "income")][1] == "2."


def test_weeks_sum_to_the_month(spark):
    from tidemark.sources.testdata import from_test_data

    t = from_test_data(spark, "/root/testdata/sf0.01")
    july = MonthWindow(1995, 7)
    for report in (reports.weekly_new_sales_by_member, reports.weekly_upsells_by_member):
        sums: dict = {}
        for r in report(t, july).collect():
            kind = "total" if r.week.startswith("total") else "weeks"
            sums[(r.name, r.type, kind)] = sums.get((r.name, r.type, kind), 0) + r.value
        assert sums
        for (name, type_, _), value in sums.items():
            assert sums[(name, type_, "total")] == sums[(name, type_, "weeks")], value
