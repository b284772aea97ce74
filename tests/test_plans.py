"""Shape of the physical plans over tables stored as Parquet."""

import re

import pytest

import __spark_entry__ as contract
from tidemark import MonthWindow, Tables
from tidemark.plans import new_sale_reports, upsell_reports, weekly_reports
from tidemark.sources.tables import REQUIRED_COLUMNS
from tidemark.sources.testdata import from_test_data

SF = "/root/testdata/sf0.01"
JULY = MonthWindow(1995, 7)

REPORTS = [
    new_sale_reports.new_sale_average,
    new_sale_reports.new_sale_rate,
    new_sale_reports.new_sale_forecast,
    new_sale_reports.new_sale_forecast_by_nru,
    new_sale_reports.nru_purchase_detail,
    upsell_reports.upsell_average,
    upsell_reports.upsell_renewal_counts,
    upsell_reports.upsell_forecast,
    upsell_reports.upsell_forecast_simple,
    weekly_reports.weekly_new_sales_by_member,
    weekly_reports.weekly_upsells_by_member,
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    derived = from_test_data(spark, SF)
    for name in REQUIRED_COLUMNS:
        getattr(derived, name).write.parquet(f"{folder}/{name}")
    return Tables.from_parquet(spark, folder), derived


@pytest.mark.parametrize("key", sorted(contract._JOBS))
def test_no_pairs_and_no_python(spark, key):
    plan = plan_of(contract.queries()[key](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert node not in plan


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__name__)
def test_stored_tables_give_the_same_rows(stored, report):
    read, derived = stored
    assert sorted(map(str, report(read, JULY).collect())) == sorted(
        map(str, report(derived, JULY).collect())
    )


def test_zoned_timestamps_in_a_utc_session(spark, stored):
    read, derived = stored
    def zoned(df):
        return df.selectExpr(
            *[f"cast({n} as timestamp) as {n}" if t == "timestamp_ntz" else n for n, t in df.dtypes]
        )

    t = Tables(**{name: zoned(getattr(read, name)) for name in REQUIRED_COLUMNS})
    assert dict(t.user_inventories.dtypes)["actual_expired_at"] == "timestamp"
    for report in REPORTS:
        if report is not new_sale_reports.nru_purchase_detail:
            assert sorted(map(str, report(t, JULY).collect())) == sorted(
                map(str, report(derived, JULY).collect())
            )
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="zoned timestamps"):
            Tables(**{name: getattr(t, name) for name in REQUIRED_COLUMNS})
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def scans_of(plan: str, table: str) -> list[str]:
    return [s for s in re.findall(r"Scan parquet.*?ReadSchema: [^\n]*", plan, re.S) if f"/{table}]" in s]


def test_month_and_codes_reach_the_scan(stored):
    read, _ = stored
    (scan,) = scans_of(plan_of(new_sale_reports.new_sale_average(read, JULY)), "purchased_packages")
    for pushed in (
        "GreaterThanOrEqual(purchased_at,1995-06-30T17:00)",
        "LessThan(purchased_at,1995-07-31T17:00)",
        "EqualTo(paid_counter,1)",
        "In(status, [2,3])",
        "GreaterThan(amount,0)",
    ):
        assert pushed in scan
    read_columns = set(re.findall(r"(\w+):", scan.split("ReadSchema: ")[1]))
    assert read_columns - {"struct"} == {
        "id", "paid_counter", "status", "amount", "local_amount", "purchased_at",
    }


def test_registrations_reach_the_scan(stored):
    read, _ = stored
    plan = plan_of(new_sale_reports.new_sale_forecast_by_nru(read, JULY))
    for table in ("users", "user_leads"):
        for scan in scans_of(plan, table):
            assert "LessThan(created_at,1995-07-31T17:00)" in scan or (
                "LessThan(created_at,1995-06-30T17:00)" in scan
            )


def tree_of(df) -> list[tuple[int, str]]:
    """(depth, node) of the physical plan before adaptive execution, from the top."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = [re.match(r"([ :|+-]*)(.*)", line).groups() for line in text.splitlines()]
    return [(len(indent), node) for indent, node in lines if node]


def below(tree: list[tuple[int, str]], at: int) -> list[str]:
    """The nodes under node `at`."""
    inside = []
    for depth, node in tree[at + 1 :]:
        if depth <= tree[at][0]:
            break
        inside.append(node)
    return inside


def above(tree: list[tuple[int, str]], at: int) -> list[str]:
    """The nodes over node `at`, the nearest first."""
    nodes, depth = [], tree[at][0]
    for outer, node in reversed(tree[:at]):
        if outer < depth:
            nodes.append(node)
            depth = outer
    return nodes


@pytest.fixture
def no_broadcasts(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "9999"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


SUMMARIES = {
    "R6": lambda t: upsell_reports.upsell_renewal_counts(t, JULY),
    "R7": lambda t: upsell_reports.upsell_forecast(t, JULY),
    "D15": lambda t: upsell_reports.expiring_user_count(t, n=JULY),
    "D17": lambda t: upsell_reports.renewer_counts(t, JULY),
}


@pytest.mark.parametrize("report", SUMMARIES.values(), ids=SUMMARIES)
def test_inventories_are_read_twice_and_cut_before_any_exchange(spark, stored, no_broadcasts, report):
    """One read makes the filter of the month's users; the other is cut by it right above the scan."""
    read, _ = stored
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tree = tree_of(report(read))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    scans = [at for at, (_, node) in enumerate(tree) if "FileScan" in node and "user_inventories" in node]
    whole = [at for at in scans if "1995-07-31" not in tree[at][1]]
    assert len(scans) <= 2 and len(whole) == 1
    nodes = above(tree, whole[0])
    exchange = next(i for i, node in enumerate(nodes) if "Exchange" in node)
    assert any("Filter" in node and "getbit" in node for node in nodes[:exchange])


@pytest.mark.parametrize(
    ("report", "aggregate"),
    [
        (lambda t: new_sale_reports.new_sale_rate(t, JULY), "created_at"),
        (lambda t: new_sale_reports.new_sale_forecast(t, JULY), "partial_count(1)"),
    ],
    ids=["cohort_counts", "nru_call_weights"],
)
def test_histories_are_cut_down_before_they_are_grouped(stored, no_broadcasts, report, aggregate):
    read, _ = stored
    tree = tree_of(report(read))
    found = [
        i for i, (_, node) in enumerate(tree)
        if "HashAggregate" in node and "partial_" in node and aggregate in node
        and any("LeftSemi" in inner for inner in below(tree, i))
    ]
    assert found


def test_calls_are_read_once(stored):
    read, _ = stored
    assert len(scans_of(plan_of(new_sale_reports.new_sale_forecast(read, JULY)), "user_calls")) == 1


def test_only_the_month_s_inventories_are_sorted(stored, no_broadcasts):
    """Below the window over users lie only the rows that the filter of the month's users lets through."""
    read, _ = stored
    df = upsell_reports.expiring_user_count(read, n=JULY)
    for scan in scans_of(plan_of(df), "user_inventories"):
        assert "package_type" not in scan.split("ReadSchema: ")[1]
    tree = tree_of(df)
    assert any("Window [" in node and "lag(" in node for _, node in tree)
    for at, (_, node) in enumerate(tree):
        if "FileScan" in node and "user_inventories" in node and "1995-07-31" not in node:
            assert any("getbit" in outer for outer in above(tree, at))


def test_building_plans_starts_no_job(spark):
    """Every registered query over the business tables is planned without running anything."""
    counts = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    opened = from_test_data(spark, SF)
    before = counts()
    for key in contract._JOBS:
        contract._JOBS[key](opened)
    assert counts() == before


def test_partitioned_tables_are_pruned(spark, stored, tmp_path):
    _, derived = stored
    for name in REQUIRED_COLUMNS:
        df = getattr(derived, name)
        if name == "purchased_packages":
            df.selectExpr("*", "date(purchased_at) as day").write.partitionBy("day").parquet(f"{tmp_path}/{name}")
        else:
            df.write.parquet(f"{tmp_path}/{name}")
    tables = Tables.from_parquet(spark, str(tmp_path), days={"purchased_packages": ("purchased_at", "day")})
    report = new_sale_reports.new_sale_average(tables, JULY)
    (scan,) = scans_of(plan_of(report), "purchased_packages")
    filters = re.search(r"PartitionFilters: ([^\n]*)", scan)[1]
    assert "1995-06-30" in filters and "1995-07-31" in filters
    assert report.collect() == new_sale_reports.new_sale_average(derived, JULY).collect()


def test_tables_from_the_catalog(spark, stored):
    read, derived = stored
    spark.sql("create database if not exists subscriptions")
    try:
        for name in REQUIRED_COLUMNS:
            getattr(derived, name).createOrReplaceTempView(f"v_{name}")
            spark.sql(f"create table subscriptions.{name} using parquet as select * from v_{name}")
        tables = Tables.from_catalog(spark, "subscriptions")
        for report in (new_sale_reports.new_sale_rate, weekly_reports.weekly_upsells_by_member):
            assert sorted(map(str, report(tables, JULY).collect())) == sorted(
                map(str, report(read, JULY).collect())
            )
    finally:
        spark.sql("drop database subscriptions cascade")


@pytest.fixture
def small_skew(spark):
    """Settings under which adaptive execution sees skew in small data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "100",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_counts_before_joins_leave_no_hot_key(spark, stored, small_skew):
    """The aggregating reports shuffle one row per key and task, so nothing is split."""
    read, _ = stored
    for report in REPORTS:
        if report is not new_sale_reports.nru_purchase_detail:
            df = report(read, JULY)
            df.collect()
            assert "skew=true" not in df._jdf.queryExecution().executedPlan().toString()
