"""Reports kept by month, tables in buckets, SQL table functions, several roles, number patterns."""

import pytest

import __spark_entry__ as contract
from oracle.queries import oracle_texts
from tests.parity import TESTDATA, assert_same, connect
from tests.test_plans import plan_of
from tidemark import MonthWindow, Tables
from tidemark.functions.number_text import number_text
from tidemark.operators.renewal_summary import renewal_counts
from tidemark.plans import table_functions, upsell_reports, weekly_reports
from tidemark.sources.sink import store_month, stored
from tidemark.sources.testdata import from_test_data

SF = f"{TESTDATA}/sf0.01"
JULY = MonthWindow(1995, 7)


@pytest.mark.parametrize("key", [*contract._CALLED, *contract._STORED])
def test_parity(spark, key):
    assert assert_same(contract.queries()[key](spark, SF), connect("sf0.01"), contract.oracle_sql()[key]) > 0


# The sink


def rows_of(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_a_rerun_changes_nothing_and_other_months_stay(spark, tmp_path):
    t, folder = from_test_data(spark, SF), str(tmp_path)
    months = [JULY.previous(), JULY]
    for month in months:
        store_month(weekly_reports.weekly_upsells_by_member(t, month), folder, "weekly", month)
    before = rows_of(stored(spark, folder, "weekly"))
    store_month(weekly_reports.weekly_upsells_by_member(t, JULY), folder, "weekly", JULY)
    assert rows_of(stored(spark, folder, "weekly")) == before
    for month in months:
        only = stored(spark, folder, "weekly", month)
        assert rows_of(only.drop("year", "month")) == rows_of(weekly_reports.weekly_upsells_by_member(t, month))
        plan = only._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan


def test_a_month_may_read_what_it_replaces_and_may_become_empty(spark, tmp_path):
    folder = str(tmp_path)
    store_month(spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string"), folder, "r", JULY)
    store_month(spark.createDataFrame([(9, "z")], "n int, t string"), folder, "r", JULY.next())
    own = stored(spark, folder, "r", JULY).drop("year", "month")
    store_month(own.selectExpr("n * 10 as n", "t"), folder, "r", JULY)
    assert sorted(tuple(r) for r in stored(spark, folder, "r").collect()) == [(9, "z", 1995, 8), (10, "a", 1995, 7), (20, "b", 1995, 7)]
    own = stored(spark, folder, "r", JULY).drop("year", "month")
    store_month(own.where("n < 0"), folder, "r", JULY)
    assert [tuple(r) for r in stored(spark, folder, "r").collect()] == [(9, "z", 1995, 8)]
    with pytest.raises(ValueError, match="year"):
        store_month(spark.range(1).selectExpr("id as Year"), folder, "r", JULY)


# Buckets


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    spark.sql(f"create database bucketed location '{tmp_path_factory.mktemp('bucketed')}'")
    yield from_test_data(spark, SF).store_bucketed("bucketed", 4)
    spark.sql("drop database bucketed cascade")


def exchanges(df) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_users_of_bucketed_tables_need_no_exchange(spark, bucketed):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        due = renewal_counts(bucketed.user_inventories, expiring=JULY)
        main = [line for line in exchanges(due) if "user_id" in line]
        assert main == [] and exchanges(renewal_counts(from_test_data(spark, SF).user_inventories, expiring=JULY)) != []
        both = bucketed.purchased_packages.join(bucketed.user_inventories, bucketed.purchased_packages.customer_id == bucketed.user_inventories.user_id)
        assert exchanges(both) == []
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert isinstance(bucketed, Tables)
    assert due.first().expiring == renewal_counts(from_test_data(spark, SF).user_inventories, expiring=JULY).first().expiring


@pytest.mark.parametrize("report", [upsell_reports.upsell_renewal_counts, upsell_reports.upsell_forecast, weekly_reports.weekly_new_sales_by_member])
def test_bucketed_tables_give_the_same_rows(spark, bucketed, report):
    assert rows_of(report(bucketed, JULY)) == rows_of(report(from_test_data(spark, SF), JULY))


# SQL table functions


@pytest.mark.parametrize("year_month", [(1995, 12), (1996, 1), (1996, 2), (1994, 3)])
def test_functions_of_other_months(spark, year_month):
    con, texts = connect("sf0.01"), oracle_texts(*year_month)
    names = table_functions.register(spark, from_test_data(spark, SF))
    assert [n.removeprefix("tidemark_") for n in names] == list(table_functions.FUNCTIONS)
    for name in names:
        found = spark.sql(f"select * from {name}({year_month[0]}, {year_month[1]})")
        assert_same(found, con, texts[name.removeprefix("tidemark_")])


@pytest.mark.parametrize("name", table_functions.FUNCTIONS)
def test_functions_make_no_pairs(spark, name):
    plan = plan_of(contract.queries()[f"sql_{name}"](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert node not in plan


def test_arguments_are_typed_and_reach_the_scan(spark, tmp_path):
    t = from_test_data(spark, SF)
    t.purchased_packages.write.parquet(f"{tmp_path}/p")
    stored_table = Tables(**{**{n: getattr(t, n) for n in ("users", "user_leads", "user_calls", "admins", "packages", "user_inventories")}, "purchased_packages": spark.read.parquet(f"{tmp_path}/p")})
    table_functions.register(spark, stored_table)
    found = spark.sql("select * from tidemark_new_sale_average(report_month => 7, report_year => 1995)")
    scans = [s for s in plan_of(found).split("Scan parquet") if "purchased_at" in s.split("ReadSchema")[0]]
    assert any("GreaterThanOrEqual(purchased_at,1995-06-30T17:00)" in scan for scan in scans)
    assert found.first() == spark.sql("select * from tidemark_new_sale_average(1995, 7)").first()
    with pytest.raises(Exception, match="(?i)month|cast|date"):
        spark.sql("select * from tidemark_new_sale_average(1995, 13)").collect()


# Number patterns

DOCUMENTED = [
    ("-0.1", "99.99", "  -.10"),
    ("-0.1", "FM9.99", "-.1"),
    ("0.1", "0.9", " 0.1"),
    ("12", "9990999.9", "    0012.0"),
    ("12", "FM9990999.9", "0012."),
    ("485", "999", " 485"),
    ("-485", "999", "-485"),
    ("1485", "9,999", " 1,485"),
    ("1485", "9G999", " 1,485"),
    ("148.5", "999.999", " 148.500"),
    ("148.5", "FM999.999", "148.5"),
    ("148.5", "FM999.990", "148.500"),
    ("148.5", "999D999", " 148.500"),
    ("3148.5", "9G999D999", " 3,148.500"),
    ("1485", "999", " ###"),
    ("-1485", "FM999.9", "-###.#"),
    ("0", "FM9.99", "0."),
    ("0", "999", "   0"),
    ("0.5", "FM999.99", ".5"),
    ("5", "FM9.99", "5."),
    ("1234567.5", "FM99G999G999G999D", "1,234,568."),
    ("99999999999.4", "FM99G999G999G999D", "99,999,999,999."),
    ("100000000000", "FM99G999G999G999D", "##,###,###,###."),
    ("7", "000", " 007"),
    ("-7", "FM000", "-007"),
    ("0.05", "FM0.99", "0.05"),
    ("-0.001", "FM9.9", "0."),
    (None, "999", None),
]


@pytest.mark.parametrize(("value", "pattern", "text"), DOCUMENTED)
def test_documented_patterns(spark, value, pattern, text):
    column = "cast(null as decimal(20, 4))" if value is None else f"cast({value} as decimal(20, 4))"
    assert spark.sql(f"select {number_text(column, pattern)} as t").first().t == text
    if value is not None:
        assert spark.sql(f"select {number_text(f'double({value})', pattern)} as t").first().t == text


@pytest.mark.parametrize("pattern", ["", "FM", "x9", "9.9.9", "9V9", "S9", "9" * 40])
def test_other_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        number_text("1", pattern)
