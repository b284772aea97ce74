"""Reports as SQL table functions: `select * from tidemark_upsell_average(2022, 6)`.

A function's body is one SELECT over temporary views of the tables; year and month are typed arguments,
of which Spark folds the month's bounds into literals, so filters reach the scan as in the reports made
of DataFrames. Conditions, week numbers and number text are the same expressions as theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.constants import (
    BUSINESS_ZONE,
    INCOME_TYPE,
    ORDER_TYPE,
    TOTAL_AMOUNT_WEEK,
    TOTAL_ORDER_WEEK,
    UPGRADE_PACKAGE_TYPE,
)
from tidemark.functions.figures import grouped_whole, ratio, ratio_or_zero
from tidemark.functions.month import MonthWindow, local_day, monday, week_of_month
from tidemark.operators.renewals import IS_ACTIVE
from tidemark.operators.sales import IS_FIRST_PAID, IS_NEW_SALE, IS_PAID, IS_REPEAT_SALE
from tidemark.plans import new_sale_reports, upsell_reports, weekly_reports
from tidemark.sources.tables import REQUIRED_COLUMNS, Tables

PREFIX = "tidemark_"


class ArgumentMonth:
    """The month named by a function's arguments, or some months from it, in the words of `MonthWindow`."""

    def __init__(self, zone: str, shift: int = 0):
        self.zone, self.shift = zone, shift
        self.start, self.end = (
            f"convert_timezone('{zone}', 'UTC', cast(add_months(make_date(report_year, report_month, 1), {months}) as timestamp_ntz))"
            for months in (shift, shift + 1)
        )

    def previous(self) -> ArgumentMonth:
        return ArgumentMonth(self.zone, self.shift - 1)

    def contains(self, column: str) -> str:
        return f"({column} >= {self.start} and {column} < {self.end})"

    def contains_short(self, column: str) -> str:
        return f"({column} >= {self.start} and {column} < {self.end} - interval '0.000001' second)"

    def is_after(self, column: str) -> str:
        return f"({column} < {self.start})"

    def local_day(self, column: str) -> str:
        return local_day(column, self.zone)


def _view(name: str) -> str:
    return f"{PREFIX}{name}"


def _registered() -> str:
    return f"(select id, created_at from {_view('users')} union all select id, created_at from {_view('user_leads')})"


def _repeat_sales() -> str:
    kept = f"(select mongo_id, package_type from {_view('packages')} where package_type <> {UPGRADE_PACKAGE_TYPE})"
    return f"{_view('purchased_packages')} p join {kept} k on k.mongo_id = p.package_id"


def _average(source: str, condition: str, month: ArgumentMonth, count: str, average: str) -> str:
    totals = (
        f"select count(p.id) as {count}, sum(p.local_amount) as total_amount"
        f" from {source} where {condition} and {month.contains('p.purchased_at')}"
    )
    return f"select {{columns}} from (select *, {ratio('total_amount', count)} as {average} from ({totals}))"


def _new_sale_average(month: ArgumentMonth) -> str:
    return _average(f"{_view('purchased_packages')} p", IS_NEW_SALE, month, "total_count", "average")


def _upsell_average(month: ArgumentMonth) -> str:
    return _average(_repeat_sales(), IS_REPEAT_SALE, month, "number_upsale", "net_upsale_average")


def _new_sale_rate(month: ArgumentMonth) -> str:
    return f"""
    with buyers as (
      select customer_id, bool_or(amount > 0) as paid, bool_or(amount > 0 and purchased_at >= claimed_at) as claimed
      from {_view("purchased_packages")} where {IS_FIRST_PAID} and {month.contains("purchased_at")} group by customer_id
    ), known as (
      select id, bool_or(here) as in_month, bool_or(earlier) as before from (
        select id, {month.contains("created_at")} as here, {month.is_after("created_at")} as earlier
        from {_registered()} where created_at < {month.end}
      ) group by id
    ), counts as (
      select count_if(in_month and paid) as bought, count_if(in_month and claimed) as claimed, count_if(before) as earlier
      from known join buyers on customer_id = id
    )
    select {{columns}} from (
      select {ratio_or_zero("bought", "claimed")} * 100 as newsale_rate_in_month,
             {ratio_or_zero("earlier + bought", "claimed + earlier")} * 100 as newsale_rate_real from counts
    )"""


def _nru_purchase_detail(month: ArgumentMonth) -> str:
    day = month.local_day("created_at")
    registered = (
        f"select id as nru_id, created_at as nru_created_at, weekofyear({day}) as isoweek,"
        f" {monday(day)} as first_day_of_week, {week_of_month(day)} as week"
        f" from {_registered()} where {month.contains('created_at')}"
    )
    sales = f"select * from {_view('purchased_packages')} where {IS_NEW_SALE}"
    return f"select {{columns}} from ({sales}) p join ({registered}) r on p.customer_id = r.nru_id"


_COHORT = ["total_count", "total_amount", "bought", "claimed"]


def _last_sales(last: ArgumentMonth) -> str:
    """Per customer of the month: orders and income of new sales, and whether one is claimed."""
    return f"""
    select customer_id, count(id) as orders, sum(local_amount) as income, bool_or(purchased_at >= claimed_at) as claimed
    from {_view("purchased_packages")} where {IS_NEW_SALE} and {last.contains("purchased_at")} group by customer_id"""


def _cohort_sales(last: ArgumentMonth, registered: str) -> str:
    """One row: the month's orders and income and, of its buyers, those registered in it (`bought`, `claimed`)."""
    return f"""
    select coalesce(sum(orders), 0L) as total_count, sum(income) as total_amount, count(r.id) as bought,
           count_if(r.id is not null and claimed) as claimed
    from ({_last_sales(last)}) left join (
      select distinct id from {registered} where id is not null and {last.contains("created_at")}
    ) r on r.id = customer_id"""


def _side_by_side(one: str, its: list[str], other: str, others: list[str]) -> str:
    """Two one-row selects as one row, stacked and merged."""
    kept = lambda own: ", ".join(c if c in own else f"null as {c}" for c in its + others)
    merged = ", ".join(f"max({c}) as {c}" for c in its + others)
    return f"select {merged} from (select {kept(its)} from ({one}) union all select {kept(others)} from ({other}))"


def _new_sale_forecast_by_nru(month: ArgumentMonth) -> str:
    last = month.previous()
    counts = f"""
      select count_if(here) as total_nru_this_month, count_if(earlier) as total_nru_last_month from (
        select {month.contains("created_at")} as here, {last.contains("created_at")} as earlier
        from {_registered()} where id is not null and created_at >= {last.start} and created_at < {month.end}
      )"""
    row = _side_by_side(_cohort_sales(last, _registered()), _COHORT, counts, ["total_nru_this_month", "total_nru_last_month"])
    rate, average = ratio("bought", "total_nru_last_month"), ratio("total_amount", "total_count")
    return f"""
    select {{columns}} from (
      select rate as rate_new_sale_last_month, total_nru_this_month, average as average_new_sale_last_month,
             average * rate * total_nru_this_month as real_money
      from (select {rate} as rate, {average} as average, * from ({row}))
    )"""


def _new_sale_forecast(month: ArgumentMonth) -> str:
    last = month.previous()
    called = f"(select id, created_at from {_view('users')} where id in (select user_id from {_view('user_calls')}) union all select id, created_at from {_view('user_leads')})"
    weights = f"""
      select coalesce(sum(weight), 0L) as nru from (
        select weight from {_view("users")} u join (
          select user_id, count(*) as weight from {_view("user_calls")} group by user_id
        ) c on c.user_id = u.id where {month.contains("u.created_at")}
        union all
        select 1L from {_view("user_leads")} where id is not null and {month.contains("created_at")}
      )"""
    row = _side_by_side(_cohort_sales(last, called), _COHORT, weights, ["nru"])
    rate, average = ratio_or_zero("bought", "claimed"), ratio("total_amount", "total_count")
    return f"""
    select {{columns}} from (
      select rate as newsale_rate_last_month, nru as total_nru_this_month, average as average_new_sale_last_month,
             rate * nru as total_nru_new_sale_success, rate * nru * average as predict_money
      from (select {rate} * 100 as rate, {average} as average, * from ({row}))
    )"""


def _upsell_forecast_simple(month: ArgumentMonth) -> str:
    last, expiry = month.previous(), "actual_expired_at"
    users = f"""
      select count_if(in_last) as expired_last, count_if(in_this) as expired_this from (
        select user_id, bool_or(earlier) as in_last, bool_or(here) as in_this from (
          select user_id, {last.contains(expiry)} as earlier, {month.contains(expiry)} as here
          from {_view("user_inventories")}
          where user_id is not null and {IS_ACTIVE} and {expiry} >= {last.start} and {expiry} < {month.end}
            and purchased_package_id in (select mongo_id from {_view("purchased_packages")} where {IS_PAID})
        ) group by user_id
      )"""
    totals = f"""
      select count(p.id) as total_count, sum(p.local_amount) as total_amount
      from {_repeat_sales()} where {IS_REPEAT_SALE} and {last.contains("p.purchased_at")}"""
    row = _side_by_side(users, ["expired_last", "expired_this"], totals, ["total_count", "total_amount"])
    rate, average = ratio_or_zero("expired_last", "expired_last"), ratio_or_zero("total_amount", "total_count")
    return f"""
    select {{columns}} from (
      select expired_this as user_expired_this_month, average as average_this_month, rate as rate_upsale_last_month,
             expired_this * average * rate as real_net_sale_this_month
      from (select {rate} as rate, {average} as average, * from ({row}))
    )"""


def _weekly(source: str, condition: str, month: ArgumentMonth) -> str:
    week = week_of_month(month.local_day("p.purchased_at"))
    average = f"if(name is null, null, {grouped_whole(ratio('m.income', 'm.orders'))})"
    line = lambda week, kind, value: f"named_struct('week', string({week}), 'type', '{kind}', 'value', {value})"
    months = f"{line(repr(TOTAL_ORDER_WEEK), ORDER_TYPE, 'm.orders')}, {line(repr(TOTAL_AMOUNT_WEEK), INCOME_TYPE, 'm.income')}"
    weeks = f"{line('w.week', ORDER_TYPE, 'w.orders')}, {line('w.week', INCOME_TYPE, 'w.income')}"
    return f"""
    with weekly as (
      select a.name, {week} as week, count(p.id) as orders, sum(p.local_amount) as income
      from {source} join {_view("admins")} a on a.admin_id = p.admin_id
      where {condition} and {month.contains_short("p.purchased_at")} group by a.name, {week}
    ), monthly as (
      select name, sum(orders) as orders, sum(income) as income, collect_list(struct(week, orders, income)) as weeks
      from weekly group by name
    ), lines as (
      select name, {average} as average, explode(concat(flatten(transform(weeks, w -> array({weeks}))), array({months}))) as line
      from monthly m
    )
    select {{columns}} from (select name, line.week, line.type, line.value, average from lines)"""


def _weekly_new_sales(month: ArgumentMonth) -> str:
    return _weekly(f"{_view('purchased_packages')} p", IS_NEW_SALE, month)


def _weekly_upsells(month: ArgumentMonth) -> str:
    return _weekly(_repeat_sales(), IS_REPEAT_SALE, month)


#: Function, its body, and the report of DataFrames that says the columns.
FUNCTIONS: dict[str, tuple[Callable[[ArgumentMonth], str], Callable[[Tables, MonthWindow], DataFrame]]] = {
    "new_sale_average": (_new_sale_average, new_sale_reports.new_sale_average),
    "new_sale_forecast": (_new_sale_forecast, new_sale_reports.new_sale_forecast),
    "new_sale_forecast_by_nru": (_new_sale_forecast_by_nru, new_sale_reports.new_sale_forecast_by_nru),
    "new_sale_rate": (_new_sale_rate, new_sale_reports.new_sale_rate),
    "nru_purchase_detail": (_nru_purchase_detail, new_sale_reports.nru_purchase_detail),
    "upsell_average": (_upsell_average, upsell_reports.upsell_average),
    "upsell_forecast_simple": (_upsell_forecast_simple, upsell_reports.upsell_forecast_simple),
    "weekly_new_sales_by_member": (_weekly_new_sales, weekly_reports.weekly_new_sales_by_member),
    "weekly_upsells_by_member": (_weekly_upsells, weekly_reports.weekly_upsells_by_member),
}


def register(spark: SparkSession, tables: Tables, zone: str = BUSINESS_ZONE) -> list[str]:
    """Make temporary views and functions of this session; returns the functions' names."""
    for name in REQUIRED_COLUMNS:
        getattr(tables, name).createOrReplaceTempView(_view(name))
    for name, (body, report) in FUNCTIONS.items():
        schema = report(tables, MonthWindow(2000, 1, zone)).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        text = body(ArgumentMonth(zone)).replace("{columns}", ", ".join(f"`{f.name}`" for f in schema))
        spark.sql(
            f"create or replace temporary function {PREFIX}{name}(report_year int, report_month int)"
            f" returns table ({columns}) return {text}"
        )
    return [f"{PREFIX}{name}" for name in FUNCTIONS]
