"""Number text, ratios and the checks of a month."""

import pytest

from tests.build import tables
from tidemark import MonthWindow
from tidemark.functions.figures import grouped_whole, ratio, ratio_or_zero
from tidemark.plans import new_sale_reports, upsell_reports

JULY = MonthWindow(2022, 7)


@pytest.mark.parametrize(
    ("value", "text"),
    [
        ("0d", "0."),
        ("0.5d", "0."),
        ("1.5d", "2."),
        ("2.5d", "2."),
        ("999.49d", "999."),
        ("1234567.5d", "1,234,568."),
        ("-1234.4d", "-1,234."),
        ("99999999999d", "99,999,999,999."),
        ("99999999999.6d", "##,###,###,###."),
        ("-123456789012d", "-##,###,###,###."),
        ("double(null)", None),
    ],
)
def test_number_text(spark, value, text):
    assert spark.sql(f"select {grouped_whole(value)} as x").first().x == text


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_zero_divisors_raise_in_any_mode(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        x = lambda text: spark.sql(f"select {text} as x").first().x
        assert x(ratio("3", "4")) == 0.75 and x(ratio("bigint(null)", "0")) is None
        assert x(ratio_or_zero("3", "0")) == 0 and x(ratio_or_zero("bigint(null)", "2")) == 0
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            x(ratio("0", "0"))
        for report in (upsell_reports.upsell_forecast, new_sale_reports.new_sale_forecast_by_nru):
            with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
                report(tables(spark), JULY).first()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("arguments", [(2022, 0), (2022, 13), (2022, 7, "Nowhere/Land"), (2022, 7, "UTC') --"), (0, 1)])
def test_months_are_checked_when_made(arguments):
    with pytest.raises(Exception):  # noqa: B017
        MonthWindow(*arguments)
