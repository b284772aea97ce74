"""Renewal operators on tables written by hand."""



import pytest

from tests.build import inventory, purchase, tables, utc
from tidemark import MonthWindow
from tidemark.operators import renewals
from tidemark.plans import upsell_reports as reports

JULY = MonthWindow(2022, 7)
PAID = "2022-01-01T00:00:00"


def with_inventories(spark, *rows, **others):
    paid = [purchase(r[0], PAID, customer=r[1]) for r in rows]
    others.setdefault("purchased_packages", paid)
    return tables(spark, user_inventories=list(rows), **others)


def test_null_expiry_is_last(spark):
    t = with_inventories(
        spark,
        inventory(1, 1, "2022-01-01", None),
        inventory(2, 1, "2022-02-01", "2022-03-01"),
        inventory(3, 1, "2022-03-01", "2022-04-01"),
    )
    nexts = {r.id: r for r in renewals.next_by_expiry(t.user_inventories).collect()}
    assert nexts[2].next_actual_expired_at == utc("2022-04-01")
    assert nexts[3].next_actual_expired_at is None
    assert nexts[3].next_ori_started_at == utc("2022-01-01")
    assert nexts[1].next_ori_started_at is None


def test_tied_expiries_are_ordered_by_id(spark):
    t = with_inventories(
        spark,
        inventory(2, 1, "2022-02-01", "2022-07-10"),
        inventory(1, 1, "2022-01-01", "2022-07-10"),
    )
    nexts = {r.id: r.next_ori_started_at for r in renewals.next_by_expiry(t.user_inventories).collect()}
    assert nexts == {1: utc("2022-02-01"), 2: None}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        # The only package ends in the month.
        ([("2022-06-01", "2022-07-10")], 1),
        # The next one began before this ended, and ends in the month.
        ([("2022-05-01", "2022-06-10"), ("2022-06-01", "2022-07-10")], 1),
        # As before, but this one ends long before: still by the row without a next.
        ([("2022-01-01", "2022-02-10"), ("2022-06-01", "2022-07-10")], 1),
        # Renewed beyond the month.
        ([("2022-06-01", "2022-07-10"), ("2022-07-01", "2022-09-10")], 0),
        # Renewed within and beyond the month, the first renewal overlapping.
        ([("2022-06-01", "2022-07-10"), ("2022-07-01", "2022-07-20"), ("2022-07-15", "2022-09-10")], 1),
        # As before, but with gaps.
        ([("2022-05-01", "2022-06-10"), ("2022-07-01", "2022-07-20"), ("2022-07-25", "2022-09-10")], 0),
        # An undated package does not count as the next expiry.
        ([("2022-06-01", "2022-07-10"), ("2022-07-01", None)], 1),
        ([("2022-06-01", "2022-06-30T16:59:59")], 0),
        ([("2022-06-01", "2022-06-30T17:00:00")], 1),
    ],
)
def test_expiring_users(spark, rows, expected):
    t = with_inventories(spark, *[inventory(i, 1, *row) for i, row in enumerate(rows, 1)])
    whole = renewals.next_by_expiry(t.user_inventories)
    assert renewals.expiring_users(whole, n=JULY).first().n == expected
    assert reports.expiring_user_count(t, n=JULY).first().n == expected


def test_early_on_time_and_won_back(spark):
    """User 1 renews early, 2 on the local day, 3 comes back, 4 only ever starts once,
    5 starts twice on one day, 6 has no active expiry."""
    t = with_inventories(
        spark,
        inventory(1, 1, "2022-06-01", "2022-07-10"),
        inventory(2, 1, "2022-07-05", "2022-09-10"),
        # 17:30Z on the 9th is the 10th in local time.
        inventory(3, 2, "2022-06-01", "2022-07-10T10:00:00"),
        inventory(4, 2, "2022-07-09T17:30:00", "2022-09-10"),
        inventory(5, 3, "2022-03-01", "2022-04-10"),
        inventory(6, 3, "2022-07-20", "2022-09-10"),
        inventory(7, 4, "2022-07-10", "2022-07-10"),
        inventory(8, 5, "2022-07-12", "2022-07-12"),
        inventory(9, 5, "2022-07-12", "2022-09-12"),
        inventory(10, 6, "2022-06-01", "2022-07-10", status=0),
        inventory(11, 6, "2022-07-05", "2022-09-10"),
    )
    counts = reports.renewer_counts(t, JULY).first()
    assert counts.asDict() == {"early": 1, "on_time": 2, "back": 1}


def test_unpaid_purchases_do_not_expire(spark):
    rows = [inventory(1, 1, "2022-06-01", "2022-07-10"), inventory(2, 2, "2022-06-01", "2022-07-10")]
    t = with_inventories(
        spark, *rows, purchased_packages=[purchase(1, PAID, status=1), purchase(2, PAID, status=3)]
    )
    kept = renewals.active_expiries(t.user_inventories, t.purchased_packages, JULY)
    assert [r.user_id for r in kept.collect()] == [2]


def test_simple_rate_is_one_or_nothing(spark):
    t = with_inventories(
        spark,
        inventory(1, 1, "2022-05-01", "2022-06-10"),
        inventory(2, 2, "2022-05-01", "2022-06-10"),
        inventory(3, 2, "2022-05-01", "2022-07-10"),
    )
    row = reports.simple_renewal_rate(t, JULY).first()
    assert (row.expired_last_month, row.expired_this_month) == (2, 1)
    assert (row.matched_last_month, row.rate_upsale_last_month) == (2, 1.0)
    # The same by the join it stands for.
    last = renewals.active_expiries(t.user_inventories, t.purchased_packages, JULY.previous())
    starts = renewals.next_by_start(t.user_inventories, "started_at")
    assert last.join(starts, "user_id", "left_semi").select("user_id").distinct().count() == 2
    empty = reports.upsell_forecast_simple(tables(spark), JULY).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0)


def test_worked_rates(spark):
    """A = 5 on time, B = 30 expiring, X = 10 early, Y = 5 won back."""
    counts = spark.sql(
        "select 30L as user_expired_this_month, 10L as number_upsale_before_time,"
        " 5L as number_upsale_on_time, 5L as number_expired_ago_upsale_this_month"
    )
    row = reports.upsell_rates(counts).first()
    assert row.upsale_rate == pytest.approx(15 / 40 * 100)
    assert row.upsale_rate_real == pytest.approx(20 / 45 * 100)


def test_forecast_without_expiring_users_raises(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        reports.upsell_forecast(tables(spark), JULY).first()
