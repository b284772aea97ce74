"""DuckDB texts that say directly what each query means, without the rewrites the Spark
side uses: plain windows, plain joins, distinct counts.

A month runs between local midnights at UTC+7: `prior` to `start` is the month before,
`start` to `finish` the month itself, and `first_day` its local first day.
"""

from __future__ import annotations

_BOUNDS = """
month_bounds as (
    select first_day,
           first_day - interval '1' month - interval '7' hour as prior,
           first_day - interval '7' hour as start,
           first_day + interval '1' month - interval '7' hour as finish
    from (select make_timestamp({year}, {month}, 1, 0, 0, 0) as first_day) m
)"""

_TABLES = """
nru_source as (
    select id, min_at - (id % 10) * interval '1' day + (id % 24) * interval '1' hour as created_at
    from (select o_custkey as id, min(o_orderdate) as min_at from orders group by o_custkey) f
),
users as (select id, created_at from nru_source where id % 3 <> 0),
user_leads as (select id, created_at from nru_source where id % 3 = 0 or id % 30 = 1),
user_calls as (select event_id as id, user_id from events where event_type = 'click'),
admins as (
    select n_nationkey as admin_id, n_name as name,
           ['region' || n_regionkey, case when n_nationkey % 2 = 0 then 'even' else 'odd' end] as role_ids
    from nation
),
packages as (select concat('pkg', p_partkey) as mongo_id, p_size % 5 as package_type from part),
purchased_packages as (
    select o_orderkey as id, concat('pp', o_orderkey) as mongo_id, o_custkey as customer_id,
           o_orderkey % 27 as admin_id, concat('pkg', o_orderkey % 200) as package_id,
           row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as paid_counter,
           case o_orderstatus when 'F' then 2 when 'O' then 3 else 1 end as status,
           case when o_orderkey % 11 = 0 then 0 else cast(round(o_totalprice) as bigint) end as amount,
           cast(round(o_totalprice * 100) as bigint) as local_amount,
           o_orderdate + (o_orderkey % 24) * interval '1' hour as purchased_at,
           case when o_orderkey % 5 = 0 then null
                else o_orderdate + (o_orderkey % 24) * interval '1' hour
                     + (o_orderkey % 7 - 4) * interval '1' day end as claimed_at
    from orders
),
user_inventories as (
    select id, customer_id as user_id, mongo_id as purchased_package_id,
           case when id % 4 = 0 then 2 else 1 end as package_type,
           case when id % 10 = 0 then 0 else 1 end as status,
           purchased_at + (id % 3) * interval '1' day as original_started_at,
           purchased_at + (id % 6) * interval '1' day as started_at,
           purchased_at + (id % 3 + 30 + (id % 5) * 30 - (id % 2) * 7) * interval '1' day as original_expired_at,
           case when id % 97 = 0 then null
                else purchased_at + (id % 3 + 30 + (id % 5) * 30) * interval '1' day end as actual_expired_at
    from purchased_packages
)"""

_REGISTERED = """
registered as (select * from users union all select * from user_leads),
registered_called as (
    select u.id, u.created_at from users u join user_calls c on c.user_id = u.id
    union all
    select * from user_leads
)"""

_SALES = """
first_paid as (select * from purchased_packages where paid_counter = 1 and status in (2, 3)),
sale_new as (select * from first_paid where amount > 0),
sale_again as (
    select p.*, k.package_type
    from purchased_packages p join packages k on k.mongo_id = p.package_id
    where k.package_type <> 4
      and p.paid_counter > 1 and p.status in (2, 3) and p.amount > 0
),
sale_member_new as (
    select s.*, a.name, cast(week(s.purchased_at + interval '7' hour) as int) as weekios
    from sale_new s join admins a using (admin_id), month_bounds
    where s.purchased_at >= start and s.purchased_at < finish - interval '1' microsecond
),
sale_member_again as (
    select s.*, a.name, cast(week(s.purchased_at + interval '7' hour) as int) as weekios
    from sale_again s join admins a using (admin_id), month_bounds
    where s.purchased_at >= start and s.purchased_at < finish - interval '1' microsecond
)"""

_WEEKS = """
month_weeks as (
    select cast(monday as date) as first_day_of_week, cast(week(monday) as int) as isoweek,
           cast(row_number() over (order by monday) as int) as week
    from (select distinct date_trunc('week', d) as monday
          from (select unnest(range(first_day, first_day + interval '1' month, interval '1' day)) as d
                from month_bounds) days) mondays
)"""

_RENEWALS = """
two_months as (
    select 'last' as label, prior as lo, start as hi from month_bounds
    union all
    select 'this', start, finish from month_bounds
),
by_expiry as (
    select id, user_id, actual_expired_at, original_started_at,
           lead(actual_expired_at) over by_end as next_actual_expired_at,
           lead(original_started_at) over by_end as next_ori_started_at
    from user_inventories
    window by_end as (partition by user_id order by actual_expired_at asc nulls last, id)
),
by_start as (
    select id, user_id, original_started_at,
           lead(original_started_at) over (
               partition by user_id order by original_started_at asc nulls last, id
           ) as next_ori_started_at
    from user_inventories
),
by_started_at as (
    select id, user_id, original_started_at, started_at,
           lead(original_started_at) over (
               partition by user_id order by started_at asc nulls last, id
           ) as next_ori_started_at
    from user_inventories
),
paid_active as (
    select i.user_id, i.actual_expired_at, i.actual_expired_at + interval '7' hour as local_end
    from user_inventories i join purchased_packages p on p.mongo_id = i.purchased_package_id
    where p.status in (2, 3) and i.package_type = 1 and i.status = 1
),
expiring as (
    select m.label, count(distinct e.user_id) as users
    from two_months m left join by_expiry e
      on case when e.next_actual_expired_at is null
               then e.actual_expired_at >= m.lo and e.actual_expired_at < m.hi
               else e.actual_expired_at > e.next_ori_started_at
                    and e.next_actual_expired_at >= m.lo and e.next_actual_expired_at < m.hi end
    group by m.label
),
renewed as (
    select m.label,
           count(distinct e.user_id) filter (date_trunc('day', e.local_end)
               > date_trunc('day', s.next_ori_started_at + interval '7' hour)) as early,
           count(distinct e.user_id) filter (date_trunc('day', e.local_end)
               = date_trunc('day', s.next_ori_started_at + interval '7' hour)) as on_time
    from two_months m
         left join paid_active e on e.actual_expired_at >= m.lo and e.actual_expired_at < m.hi
         left join by_start s on s.user_id = e.user_id
    group by m.label
),
returned as (
    select count(distinct e.user_id) as users
    from paid_active e join by_start s using (user_id), month_bounds
    where e.actual_expired_at < start
      and date_trunc('month', s.next_ori_started_at + interval '7' hour) = first_day
),
renewal_counts as (
    select (select users from expiring where label = 'this') as user_expired_this_month,
           (select early from renewed where label = 'this') as number_upsale_before_time,
           (select on_time from renewed where label = 'this') as number_upsale_on_time,
           (select users from returned) as number_expired_ago_upsale_this_month
),
ended as (
    select count(distinct user_id) filter (actual_expired_at >= prior and actual_expired_at < start)
               as expired_last_month,
           count(distinct user_id) filter (actual_expired_at >= start and actual_expired_at < finish)
               as expired_this_month,
           (select count(distinct e.user_id) from paid_active e join by_started_at n using (user_id),
                   month_bounds
            where e.actual_expired_at >= prior and e.actual_expired_at < start) as matched_last_month
    from paid_active, month_bounds
)"""

_COHORTS = """
cohort as (
    select count(distinct p.customer_id) filter (p.amount > 0 and r.created_at >= start) as bought,
           count(distinct p.customer_id) filter (p.amount > 0 and r.created_at >= start
               and p.purchased_at >= p.claimed_at) as claimed,
           count(distinct r.id) filter (r.created_at < start) as earlier
    from first_paid p join registered r on r.id = p.customer_id, month_bounds
    where p.purchased_at >= start and p.purchased_at < finish and r.created_at < finish
),
cohort_last as (
    select count(distinct p.customer_id) as bought
    from sale_new p join registered r on r.id = p.customer_id, month_bounds
    where p.purchased_at >= prior and p.purchased_at < start
      and r.created_at >= prior and r.created_at < start
),
cohort_last_called as (
    select count(distinct p.customer_id) as bought,
           count(distinct p.customer_id) filter (p.purchased_at >= p.claimed_at) as claimed
    from sale_new p join registered_called r on r.id = p.customer_id, month_bounds
    where p.purchased_at >= prior and p.purchased_at < start
      and r.created_at >= prior and r.created_at < start
)"""

_MEMBERS = """
member_sales as (
    select 'new_sale' as kind, name, weekios, id, local_amount from sale_member_new
    union all
    select 'upsell', name, weekios, id, local_amount from sale_member_again
),
member_sums as (
    select kind, s.name, w.week, count(id) as orders, cast(sum(local_amount) as bigint) as income
    from member_sales s join month_weeks w on w.isoweek = s.weekios
    group by grouping sets ((kind, s.name, w.week), (kind, s.name))
),
member_totals as (
    select kind, name, orders as order_count, income as total_amount from member_sums where week is null
),
member_lines as (
    select kind, name,
           case when week is not null then cast(week as varchar)
                when type = 'order' then 'total_order' else 'total_amount' end as week,
           type, value
    from (unpivot (select kind, name, week, orders as "order", income from member_sums)
          on "order", income into name type value value)
),
member_report as (
    select l.*, format('{:,}.', cast(round_even(cast(t.total_amount as double) / t.order_count, 0)
                                     as bigint)) as average
    from member_lines l left join member_totals t on t.kind = l.kind and t.name = l.name
)"""

_WITH = "with " + ",".join(
    (_BOUNDS, _TABLES, _REGISTERED, _SALES, _WEEKS, _RENEWALS, _COHORTS, _MEMBERS)
)

_PURCHASE = """id, mongo_id, customer_id, admin_id, package_id, paid_counter, status, amount,
    local_amount, purchased_at, claimed_at"""

_AVERAGE = "cast(sum(local_amount) as double) / nullif(count(id), 0)"

_IN_MONTH = "purchased_at >= start and purchased_at < finish"
_IN_PRIOR = "purchased_at >= prior and purchased_at < start"

_QUERIES = {
    # Reports
    "new_sale_average": f"""
        select count(id) as total_count, cast(sum(local_amount) as bigint) as total_amount,
               {_AVERAGE} as average
        from sale_new, month_bounds where {_IN_MONTH}""",
    "new_sale_rate": """
        select coalesce(bought / nullif(cast(claimed as double), 0) * 100, 0) as newsale_rate_in_month,
               coalesce((earlier + bought) / nullif(cast(claimed + earlier as double), 0) * 100, 0)
                   as newsale_rate_real
        from cohort""",
    "new_sale_forecast": f"""
        select rate as newsale_rate_last_month, nru as total_nru_this_month,
               avg_order as average_new_sale_last_month,
               rate * nru as total_nru_new_sale_success, rate * nru * avg_order as predict_money
        from (select coalesce(bought / nullif(cast(claimed as double), 0) * 100, 0) as rate,
                     (select count(id) from registered_called, month_bounds
                      where created_at >= start and created_at < finish) as nru,
                     (select {_AVERAGE} from sale_new, month_bounds where {_IN_PRIOR}) as avg_order
              from cohort_last_called)""",
    "new_sale_forecast_by_nru": f"""
        select rate as rate_new_sale_last_month, nru as total_nru_this_month,
               avg_order as average_new_sale_last_month, avg_order * rate * nru as real_money
        from (select cast(bought as double)
                         / (select count(id) from registered, month_bounds
                            where created_at >= prior and created_at < start) as rate,
                     (select count(id) from registered, month_bounds
                      where created_at >= start and created_at < finish) as nru,
                     (select {_AVERAGE} from sale_new, month_bounds where {_IN_PRIOR}) as avg_order
              from cohort_last)""",
    "upsell_average": f"""
        select count(id) as number_upsale, cast(sum(local_amount) as bigint) as total_amount,
               {_AVERAGE} as net_upsale_average
        from sale_again, month_bounds where {_IN_MONTH}""",
    "upsell_renewal_counts": "select * from renewal_counts",
    "upsell_forecast": f"""
        select rate as upsale_rate_last_month, expired as number_expired_this_month,
               avg_order as net_upsale_pre_month, rate * expired as user_upsale_successfully,
               rate * expired * avg_order as predict_net_sale
        from (select cast(r.on_time + r.early as double) / (r.early + e.users) * 100 as rate,
                     (select users from expiring where label = 'this') as expired,
                     (select {_AVERAGE} from sale_again, month_bounds where {_IN_PRIOR}) as avg_order
              from renewed r join expiring e using (label) where label = 'last')""",
    "upsell_forecast_simple": f"""
        select expired_this_month as user_expired_this_month, avg_order as average_this_month,
               rate as rate_upsale_last_month,
               expired_this_month * avg_order * rate as real_net_sale_this_month
        from (select expired_this_month,
                     coalesce(matched_last_month / nullif(cast(expired_last_month as double), 0), 0)
                         as rate,
                     coalesce((select {_AVERAGE} from sale_again, month_bounds where {_IN_PRIOR}), 0)
                         as avg_order
              from ended)""",
    "weekly_new_sales_by_member": """
        select name, week, type, value, average from member_report where kind = 'new_sale'""",
    "weekly_upsells_by_member": """
        select name, week, type, value, average from member_report where kind = 'upsell'""",
    "nru_purchase_detail": """
        select s.*, r.id as nru_id, r.created_at as nru_created_at, w.isoweek, w.first_day_of_week,
               w.week
        from sale_new s join registered r on r.id = s.customer_id, month_weeks w, month_bounds
        where r.created_at >= start and r.created_at < finish
          and w.isoweek = week(r.created_at + interval '7' hour)""",
    # Operators
    "month_week_calendar": """
        with days as (
            select month_start, unnest(range(month_start, month_start + interval '1' month,
                                             interval '1' day)) as d
            from (select distinct date_trunc('month', purchased_at + interval '7' hour) as month_start
                  from purchased_packages)
        ), mondays as (
            select distinct cast(month_start as date) as month_start,
                   cast(date_trunc('week', d) as date) as first_day_of_week
            from days
        )
        select month_start, first_day_of_week, cast(week(first_day_of_week) as int) as isoweek,
               cast(row_number() over (partition by month_start order by first_day_of_week) as int) as week
        from mondays""",
    "month_week_calendar_and_next_day": """
        with days as (
            select month_start, unnest(generate_series(month_start, month_start + interval '1' month,
                                                       interval '1' day)) as d
            from (select distinct date_trunc('month', purchased_at + interval '7' hour) as month_start
                  from purchased_packages)
        ), mondays as (
            select distinct cast(month_start as date) as month_start,
                   cast(date_trunc('week', d) as date) as first_day_of_week
            from days
        )
        select month_start, first_day_of_week, cast(week(first_day_of_week) as int) as isoweek,
               cast(row_number() over (partition by month_start order by first_day_of_week) as int) as week
        from mondays""",
    "team_members": "select admin_id, name from admins where list_contains(role_ids, 'region1')",
    "weekly_new_sales_by_role": """
        select r.name, r.week, r.type, r.value, r.average
        from member_report r join admins a using (name)
        where r.kind = 'new_sale' and list_contains(a.role_ids, 'even')""",
    "team_members_of_roles": """
        select admin_id, name from admins where list_has_all(role_ids, ['region1', 'even'])""",
    "weekly_upsells_by_roles": """
        select r.name, r.week, r.type, r.value, r.average
        from member_report r join admins a using (name)
        where r.kind = 'upsell' and list_has_all(a.role_ids, ['region2', 'even'])""",
    "nru": "select * from registered",
    "nru_with_calls": "select * from registered_called",
    "new_sales": f"select {_PURCHASE} from sale_new, month_bounds where {_IN_MONTH}",
    "upsells": f"select {_PURCHASE}, package_type from sale_again, month_bounds where {_IN_MONTH}",
    "nru_month_count": """
        select count(id) filter (created_at >= start and created_at < finish) as total_nru_this_month,
               count(id) filter (created_at >= prior and created_at < start) as total_nru_last_month
        from registered, month_bounds""",
    "nru_by_week": """
        select r.id, r.created_at, w.isoweek, w.first_day_of_week, w.week
        from registered r, month_weeks w, month_bounds
        where r.created_at >= start and r.created_at < finish
          and w.isoweek = week(r.created_at + interval '7' hour)""",
    "nru_before_month": """
        select id, created_at, cast(week(created_at + interval '7' hour) as int) as isoweek
        from registered, month_bounds where created_at < start""",
    "cohort_buyers": "select bought as total_count from cohort",
    "cohort_claimed_buyers": "select claimed as total_count from cohort",
    "earlier_cohort_buyers": "select earlier as total_count from cohort",
    "average_order": f"""
        select 'new_sale' as kind, count(id) as total_count,
               cast(sum(local_amount) as bigint) as total_amount, {_AVERAGE} as average
        from sale_new, month_bounds where {_IN_MONTH}
        union all
        select 'upsell', count(id), cast(sum(local_amount) as bigint), {_AVERAGE}
        from sale_again, month_bounds where {_IN_MONTH}""",
    "next_by_expiry": "select * from by_expiry",
    "next_by_expiry_tied": """
        with tied as (
            select case when id % 7 = 0 then null else id end as id, user_id % 20 as user_id,
                   cast(date_trunc('month', actual_expired_at) as timestamp) as actual_expired_at,
                   original_started_at
            from user_inventories
        )
        select *, lead(actual_expired_at) over w as next_actual_expired_at,
               lead(original_started_at) over w as next_ori_started_at
        from tied
        window w as (partition by user_id order by actual_expired_at asc nulls last, id asc nulls last,
                     original_started_at asc nulls last)""",
    "next_by_original_expiry": """
        select id, user_id, original_expired_at, original_started_at,
               lead(original_expired_at) over w as next_original_expired_at,
               lead(original_started_at) over w as next_ori_started_at
        from user_inventories
        window w as (partition by user_id order by original_expired_at asc nulls last, id)""",
    "expiring_users": "select users as total_count from expiring where label = 'this'",
    "active_expiries": """
        select user_id, actual_expired_at from paid_active, month_bounds
        where actual_expired_at >= start and actual_expired_at < finish""",
    "early_renewers": "select early as total_count from renewed where label = 'this'",
    "on_time_renewers": "select on_time as total_count from renewed where label = 'this'",
    "next_by_start": "select * from by_start",
    "next_by_started_at": "select * from by_started_at",
    "win_back_users": "select users as total_count from returned",
    "simple_renewal_rate": """
        select *, coalesce(matched_last_month / nullif(cast(expired_last_month as double), 0), 0)
                   as rate_upsale_last_month
        from ended""",
    "upsell_rates": """
        select *,
               cast(number_upsale_on_time + number_upsale_before_time as double)
                   / (user_expired_this_month + number_upsale_before_time) * 100 as upsale_rate,
               cast(number_upsale_on_time + number_upsale_before_time
                    + number_expired_ago_upsale_this_month as double)
                   / (user_expired_this_month + number_upsale_before_time
                      + number_expired_ago_upsale_this_month) * 100 as upsale_rate_real
        from renewal_counts""",
    "renewal_users": """
        with due as (
            select label, user_id from two_months m join by_expiry e
              on case when e.next_actual_expired_at is null
                       then e.actual_expired_at >= m.lo and e.actual_expired_at < m.hi
                       else e.actual_expired_at > e.next_ori_started_at
                            and e.next_actual_expired_at >= m.lo and e.next_actual_expired_at < m.hi end
        ),
        pairs as (
            select e.user_id, e.actual_expired_at, date_trunc('day', e.local_end) as end_day,
                   date_trunc('day', s.next_ori_started_at + interval '7' hour) as start_day
            from paid_active e join by_start s using (user_id)
        ),
        kinds as (
            select distinct user_id, 'early' as kind from pairs, month_bounds
            where actual_expired_at >= start and actual_expired_at < finish and end_day > start_day
            union
            select user_id, 'on_time' from pairs, month_bounds
            where actual_expired_at >= start and actual_expired_at < finish and end_day = start_day
            union
            select user_id, 'back' from pairs, month_bounds
            where actual_expired_at < start and date_trunc('month', start_day) = first_day
            union
            select user_id, label from due
        )
        select user_id, bool_or(kind = 'early') as early, bool_or(kind = 'on_time') as on_time,
               bool_or(kind = 'back') as back, bool_or(kind = 'last') as expired_last,
               bool_or(kind = 'this') as expired_this
        from kinds group by user_id""",
    "renewal_detail": """
        select i.id, i.user_id, i.actual_expired_at,
               count(*) filter (date_trunc('day', s.next_ori_started_at + interval '7' hour)
                   < date_trunc('day', i.actual_expired_at + interval '7' hour)) as earlier_starts,
               count(*) filter (date_trunc('day', s.next_ori_started_at + interval '7' hour)
                   = date_trunc('day', i.actual_expired_at + interval '7' hour)) as same_day_starts
        from user_inventories i
             join purchased_packages p on p.mongo_id = i.purchased_package_id and p.status in (2, 3)
             join by_start s on s.user_id = i.user_id, month_bounds
        where i.package_type = 1 and i.status = 1
          and i.actual_expired_at >= start and i.actual_expired_at < finish
        group by i.id, i.user_id, i.actual_expired_at""",
    "buyers_by_month": """
        select cast(date_trunc('month', purchased_at + interval '7' hour) as date) as month,
               count(distinct customer_id) as buyers
        from purchased_packages where status in (2, 3) group by 1""",
    "buyers_by_quarter": """
        select cast(date_trunc('quarter', purchased_at + interval '7' hour) as date) as quarter,
               count(distinct customer_id) as buyers
        from purchased_packages where status in (2, 3) group by 1""",
    "returning_buyers": """
        select count(*) as buyers from (
            select customer_id from purchased_packages, month_bounds where status in (2, 3)
            group by customer_id
            having bool_or(purchased_at >= prior and purchased_at < start)
               and bool_or(purchased_at >= start and purchased_at < finish)
        ) c""",
    "cohort_triangle": """
        with registered_months as (
            select distinct id, cast(date_trunc('month', created_at + interval '7' hour) as date) as month
            from registered
        ),
        payment_months as (
            select customer_id, purchased_at, claimed_at, amount,
                   cast(date_trunc('month', purchased_at + interval '7' hour) as date) as month
            from first_paid
        )
        select r.month as registered_month, p.month as payment_month,
               count(distinct customer_id) filter (amount > 0) as bought,
               count(distinct customer_id) filter (amount > 0 and purchased_at >= claimed_at) as claimed,
               count(distinct customer_id) as paid,
               count(distinct customer_id) filter (not exists (
                   select 1 from registered_months e where e.id = r.id and e.month < r.month
               )) as newly_paid
        from payment_months p join registered_months r on r.id = p.customer_id
        group by r.month, p.month""",
    "member_new_sales": f"select {_PURCHASE}, name, weekios from sale_member_new",
    "member_upsells": f"select {_PURCHASE}, package_type, name, weekios from sale_member_again",
    "sales_with_week": """
        select s.id, s.name, s.local_amount, s.purchased_at, w.first_day_of_week, w.isoweek, w.week
        from sale_member_new s join month_weeks w on w.isoweek = s.weekios""",
    "weekly_member_metrics": "select * from member_report",
    "member_month_summary": """
        select kind, name, order_count, total_amount,
               cast(total_amount as double) / order_count as average
        from member_totals""",
}


def oracle_texts(year: int = 1995, month: int = 7) -> dict[str, str]:
    shared = _WITH.replace("{year}", str(year)).replace("{month}", str(month))
    texts = {}
    for key, body in _QUERIES.items():
        body = body.strip()
        # A query with CTEs of its own continues the shared list.
        joint = ",\n" + body[5:] if body.startswith("with ") else "\n" + body
        texts[key] = shared + joint
    return texts


def stored_text(key: str, *months: tuple[int, int]) -> str:
    """A query's rows of several months, with the columns `year` and `month`."""
    parts = [f"select *, {year} as year, {month} as month from ({oracle_texts(year, month)[key]}) m" for year, month in months]
    return "\nunion all\n".join(parts)
