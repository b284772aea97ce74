"""The input tables derived from the star-schema test data (see FIXTURES.md).

Orders play the purchases, so every table grows with them. Each customer becomes a
user, a lead or both; no customer is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.figures import exprs
from tidemark.operators.ordered import with_position
from tidemark.sources.tables import Tables


def _payments(orders: DataFrame, *also: str) -> DataFrame:
    purchased_at = "o_orderdate + (o_orderkey % 24) * interval '1' hour"
    return orders.selectExpr(
        "o_orderkey as id",
        "concat('pp', o_orderkey) as mongo_id",
        "o_custkey as customer_id",
        "o_orderkey % 27 as admin_id",
        "concat('pkg', o_orderkey % 200) as package_id",
        "case o_orderstatus when 'F' then 2 when 'O' then 3 else 1 end as status",
        "case when o_orderkey % 11 = 0 then 0 else cast(round(o_totalprice) as bigint) end as amount",
        "cast(round(o_totalprice * 100) as bigint) as local_amount",
        f"{purchased_at} as purchased_at",
        f"case when o_orderkey % 5 = 0 then null else {purchased_at}"
        " + (o_orderkey % 7 - 4) * interval '1' day end as claimed_at",
        *also,
    )


def _inventories(payments: DataFrame) -> DataFrame:
    days = "id % 3 + 30 + (id % 5) * 30"
    return payments.selectExpr(
        "id",
        "customer_id as user_id",
        "mongo_id as purchased_package_id",
        "case when id % 4 = 0 then 2 else 1 end as package_type",
        "case when id % 10 = 0 then 0 else 1 end as status",
        "purchased_at + (id % 3) * interval '1' day as original_started_at",
        "purchased_at + (id % 6) * interval '1' day as started_at",
        f"case when id % 97 = 0 then null else purchased_at + ({days}) * interval '1' day end"
        " as actual_expired_at",
        f"purchased_at + ({days} - (id % 2) * 7) * interval '1' day as original_expired_at",
    )


def from_test_data(spark: SparkSession, sf_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = read("orders")
    registered = (
        orders.groupBy("o_custkey")
        .agg(*exprs("min(o_orderdate) as first_order"))
        .selectExpr(
            "o_custkey as id",
            "first_order - (id % 10) * interval '1' day + (id % 24) * interval '1' hour as created_at",
        )
    )
    # Counted on the narrow orders, before the purchases' texts are made from them.
    counted = with_position(orders, "o_custkey", "o_orderdate", "o_orderkey", "paid_counter")
    return Tables(
        users=registered.where("id % 3 <> 0"),
        user_leads=registered.where("id % 3 = 0 or id % 30 = 1"),
        user_calls=read("events")
        .where("event_type = 'click'")
        .selectExpr("event_id as id", "user_id"),
        admins=read("nation").selectExpr(
            "n_nationkey as admin_id",
            "n_name as name",
            "array(concat('region', n_regionkey), if(n_nationkey % 2 = 0, 'even', 'odd')) as role_ids",
        ),
        packages=read("part").selectExpr(
            "concat('pkg', p_partkey) as mongo_id", "p_size % 5 as package_type"
        ),
        purchased_packages=_payments(counted, "paid_counter"),
        user_inventories=_inventories(_payments(orders)),
    )
