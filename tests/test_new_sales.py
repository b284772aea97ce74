"""New-sale reports on tables written by hand."""

import pytest

from tests.build import purchase, tables, utc
from tidemark import MonthWindow
from tidemark.operators import cohorts, registrations, sales
from tidemark.plans import new_sale_reports as reports

JULY = MonthWindow(2022, 7)
IN_JUNE, IN_JULY, EARLIER = "2022-06-10T00:00:00", "2022-07-10T00:00:00", "2022-01-01T00:00:00"


def test_what_a_new_sale_is(spark):
    rows = [
        purchase(1, IN_JULY, status=2),
        purchase(2, IN_JULY, status=3),
        purchase(3, IN_JULY, status=1),
        purchase(4, IN_JULY, counter=2),
        purchase(5, IN_JULY, amount=0),
        purchase(6, IN_JUNE),
    ]
    t = tables(spark, purchased_packages=rows)
    kept = {r.id for r in sales.new_sales(t.purchased_packages, JULY).collect()}
    assert kept == {1, 2}


def test_what_an_upsell_is(spark):
    rows = [
        purchase(1, IN_JULY, counter=2, package="plain"),
        purchase(2, IN_JULY, counter=7, package="plain"),
        purchase(3, IN_JULY, counter=1, package="plain"),
        purchase(4, IN_JULY, counter=2, package="upgrade"),
        purchase(5, IN_JULY, counter=2, package="untyped"),
        purchase(6, IN_JULY, counter=2, package="unknown"),
    ]
    packages = [("plain", 1), ("upgrade", 4), ("untyped", None)]
    t = tables(spark, purchased_packages=rows, packages=packages)
    kept = sales.upsells(t.purchased_packages, t.packages, JULY)
    assert {r.id for r in kept.collect()} == {1, 2}
    totals = sales.upsell_totals(t.purchased_packages, t.packages, JULY).first()
    assert (totals.total_count, totals.total_amount) == (2, 200)


def test_a_package_listed_twice_counts_twice(spark):
    t = tables(
        spark,
        purchased_packages=[purchase(1, IN_JULY, counter=2, package="k")],
        packages=[("k", 1), ("k", 2)],
    )
    assert sales.upsells(t.purchased_packages, t.packages, JULY).count() == 2
    assert sales.upsell_totals(t.purchased_packages, t.packages, JULY).first().total_count == 2


def test_empty_month(spark):
    t = tables(spark)
    assert reports.new_sale_average(t, JULY).first().asDict() == {
        "total_count": 0,
        "total_amount": None,
        "average": None,
    }
    rates = reports.new_sale_rate(t, JULY).first()
    assert tuple(rates) == (0.0, 0.0)
    forecast = reports.new_sale_forecast(t, JULY).first()
    assert tuple(forecast) == (0.0, 0, None, 0.0, None)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        reports.new_sale_forecast_by_nru(t, JULY).first()


def test_call_fan_out(spark):
    """A user with three calls is three registrations, a user without calls none, a lead
    one; an id in both tables counts in both."""
    t = tables(
        spark,
        users=[(1, utc(IN_JULY)), (2, utc(IN_JULY)), (3, utc(IN_JULY))],
        user_leads=[(3, utc(IN_JULY)), (4, utc(IN_JULY))],
        user_calls=[(1,), (1,), (1,), (3,), (9,)],
    )
    assert sorted(r.id for r in registrations.nru_with_calls(t).collect()) == [1, 1, 1, 3, 3, 4]
    assert registrations.nru(t).count() == 5
    weights = registrations.nru_call_weights(t, JULY, JULY).collect()
    assert sorted((r.id, r.weight) for r in weights) == [(1, 3), (3, 1), (3, 1), (4, 1)]
    assert reports.new_sale_forecast(t, JULY).first().total_nru_this_month == 6


def test_free_order_counts_only_for_earlier_registrations(spark):
    t = tables(
        spark,
        users=[(1, utc(EARLIER)), (2, utc(IN_JULY))],
        purchased_packages=[
            purchase(1, IN_JULY, customer=1, amount=0),
            purchase(2, IN_JULY, customer=2, amount=0),
        ],
    )
    buyers = cohorts.month_buyers(t.purchased_packages, JULY)
    counts = cohorts.cohort_counts(registrations.nru(t), buyers, JULY).first()
    assert (counts.bought, counts.claimed, counts.earlier) == (0, 0, 1)


def test_claimed_buyers(spark):
    """A claim must exist and not be after the purchase; all buyers are divided by these."""
    claims = {1: IN_JULY, 2: "2022-07-11T00:00:00", 3: None, 4: "2022-07-09T00:00:00"}
    t = tables(
        spark,
        users=[(i, utc(IN_JULY)) for i in claims] + [(1, utc(IN_JULY))],
        user_leads=[(4, utc(IN_JULY))],
        purchased_packages=[
            purchase(i, IN_JULY, customer=i, claimed=at) for i, at in claims.items()
        ],
    )
    buyers = cohorts.month_buyers(t.purchased_packages, JULY)
    counts = cohorts.cohort_counts(registrations.nru(t), buyers, JULY).first()
    assert (counts.bought, counts.claimed, counts.earlier) == (4, 2, 0)
    assert tuple(reports.new_sale_rate(t, JULY).first()) == (200.0, 200.0)


def test_forecasts_worked_by_hand(spark):
    """June: 4 registrations, 2 of them buy (500 in all), 1 claimed. July: 3 registrations."""
    t = tables(
        spark,
        users=[(i, utc(IN_JUNE)) for i in (1, 2, 3)] + [(i, utc(IN_JULY)) for i in (5, 6)],
        user_leads=[(4, utc(IN_JUNE)), (7, utc(IN_JULY))],
        user_calls=[(1,), (1,), (2,), (5,)],
        purchased_packages=[
            purchase(1, IN_JUNE, customer=1, local=200, claimed=IN_JUNE),
            purchase(2, IN_JUNE, customer=4, local=300),
            purchase(3, IN_JUNE, customer=None, local=400),
        ],
    )
    # 2 buyers / 1 claimed = 200 (percent); calls leave user 5 and lead 7; average 900 / 3.
    assert tuple(reports.new_sale_forecast(t, JULY).first()) == (200.0, 2, 300.0, 400.0, 120000.0)
    # 2 buyers / 4 registrations; 3 registrations now.
    by_nru = reports.new_sale_forecast_by_nru(t, JULY).first()
    assert tuple(by_nru) == (0.5, 3, 300.0, 450.0)


def test_purchase_detail_has_any_purchase_date(spark):
    t = tables(
        spark,
        users=[(1, utc("2022-06-30T17:00:00")), (2, utc(IN_JUNE))],
        purchased_packages=[
            purchase(1, "2023-05-05T00:00:00", customer=1),
            purchase(2, IN_JULY, customer=2),
        ],
    )
    (row,) = reports.nru_purchase_detail(t, JULY).collect()
    assert (row.id, row.nru_id, row.isoweek, row.week) == (1, 1, 26, 1)
