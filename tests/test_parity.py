"""Every registered query against its SQL text, at two scales."""

import pytest

import __spark_entry__ as contract
from oracle.queries import oracle_texts
from tests.parity import TESTDATA, assert_same, connect
from tidemark import MonthWindow
from tidemark.plans import new_sale_reports, upsell_reports, weekly_reports
from tidemark.sources.testdata import from_test_data

QUERIES = {key: contract.queries()[key] for key in contract._JOBS}
ORACLE = contract.oracle_sql()


def test_every_query_has_a_text():
    assert set(QUERIES) == set(oracle_texts()) <= set(ORACLE)


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def scale(request):
    return request.param, connect(request.param)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_parity(spark, scale, key):
    sf, con = scale
    rows = assert_same(QUERIES[key](spark, f"{TESTDATA}/{sf}"), con, ORACLE[key])
    assert rows > 0


REPORTS = {
    "new_sale_average": new_sale_reports.new_sale_average,
    "new_sale_rate": new_sale_reports.new_sale_rate,
    "new_sale_forecast": new_sale_reports.new_sale_forecast,
    "new_sale_forecast_by_nru": new_sale_reports.new_sale_forecast_by_nru,
    "upsell_average": upsell_reports.upsell_average,
    "upsell_renewal_counts": upsell_reports.upsell_renewal_counts,
    "upsell_forecast": upsell_reports.upsell_forecast,
    "upsell_forecast_simple": upsell_reports.upsell_forecast_simple,
    "weekly_new_sales_by_member": weekly_reports.weekly_new_sales_by_member,
    "weekly_upsells_by_member": weekly_reports.weekly_upsells_by_member,
    "nru_purchase_detail": new_sale_reports.nru_purchase_detail,
}


@pytest.mark.parametrize("year_month", [(1995, 3), (1995, 5), (1995, 8), (1995, 12), (1996, 1), (1996, 3)])
def test_other_months(spark, year_month):
    """Months before and after 30 and 31 days, and over a year's end."""
    con, texts = connect("sf0.01"), oracle_texts(*year_month)
    tables = from_test_data(spark, f"{TESTDATA}/sf0.01")
    for key, report in REPORTS.items():
        assert_same(report(tables, MonthWindow(*year_month)), con, texts[key])


def test_entry(spark):
    assert contract.entry(spark).count() == 24
