"""Small tables written by hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark import Tables

SCHEMAS = {
    "users": "id bigint, created_at timestamp_ntz",
    "user_leads": "id bigint, created_at timestamp_ntz",
    "user_calls": "user_id bigint",
    "admins": "admin_id bigint, name string",
    "packages": "mongo_id string, package_type int",
    "purchased_packages": (
        "id bigint, mongo_id string, customer_id bigint, admin_id bigint, package_id string,"
        " paid_counter bigint, status int, amount bigint, local_amount bigint,"
        " purchased_at timestamp_ntz, claimed_at timestamp_ntz"
    ),
    "user_inventories": (
        "id bigint, user_id bigint, purchased_package_id string, package_type int, status int,"
        " original_started_at timestamp_ntz, started_at timestamp_ntz,"
        " actual_expired_at timestamp_ntz"
    ),
}


def utc(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def frame(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMAS[name])


def tables(spark: SparkSession, **rows: list[tuple]) -> Tables:
    return Tables(**{name: frame(spark, name, rows.get(name, [])) for name in SCHEMAS})


def purchase(
    id: int,
    at: str,
    customer: int = 1,
    counter: int = 1,
    status: int = 2,
    amount: int = 1,
    local: int = 100,
    admin: int = 1,
    package: str = "k1",
    claimed: str | None = None,
) -> tuple:
    return (
        id, f"pp{id}", customer, admin, package, counter, status, amount, local, utc(at), utc(claimed),
    )


def inventory(
    id: int,
    user: int | None,
    start: str | None,
    expiry: str | None,
    purchase_id: int | None = None,
    package_type: int = 1,
    status: int = 1,
    started: str | None = None,
) -> tuple:
    paid = f"pp{id if purchase_id is None else purchase_id}"
    return (id, user, paid, package_type, status, utc(start), utc(started or start), utc(expiry))
