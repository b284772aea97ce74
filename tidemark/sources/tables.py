"""The seven input tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.month import MonthWindow

REQUIRED_COLUMNS = {
    "users": ("id", "created_at"),
    "user_leads": ("id", "created_at"),
    "user_calls": ("user_id",),
    "admins": ("admin_id", "name"),
    "packages": ("mongo_id", "package_type"),
    "purchased_packages": (
        "id",
        "mongo_id",
        "customer_id",
        "admin_id",
        "package_id",
        "paid_counter",
        "status",
        "amount",
        "local_amount",
        "purchased_at",
        "claimed_at",
    ),
    "user_inventories": (
        "id",
        "user_id",
        "purchased_package_id",
        "package_type",
        "status",
        "original_started_at",
        "started_at",
        "actual_expired_at",
    ),
}

#: The column by which a stored table is divided into buckets; each bucket is sorted by it.
BUCKETS = {
    "users": "id",
    "user_leads": "id",
    "user_calls": "user_id",
    "purchased_packages": "customer_id",
    "user_inventories": "user_id",
}

_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


@dataclass(frozen=True)
class Tables:
    """DataFrames of the input tables; timestamps are TIMESTAMP_NTZ in UTC.

    Zoned TIMESTAMP columns are accepted while the session zone is UTC, where Spark
    compares and converts them as the same instants.
    """

    users: DataFrame
    user_leads: DataFrame
    user_calls: DataFrame
    admins: DataFrame
    packages: DataFrame
    purchased_packages: DataFrame
    user_inventories: DataFrame
    days: dict[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, columns in REQUIRED_COLUMNS.items():
            df = getattr(self, name)
            missing = [c for c in columns if c not in df.columns]
            if missing:
                raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
            zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
            if zoned and df.sparkSession.conf.get("spark.sql.session.timeZone") not in _UTC_NAMES:
                raise ValueError(
                    f"{name} has zoned timestamps ({', '.join(zoned)}): "
                    "set spark.sql.session.timeZone to UTC or store TIMESTAMP_NTZ"
                )

    def within(self, name: str, moment: str, first: MonthWindow, last: MonthWindow | None = None) -> DataFrame:
        """The table without partitions that hold no `moment` from month `first` to `last`.

        Bounds on the moment itself are still the caller's; this adds those on its day.
        """
        df = getattr(self, name)
        if self.days.get(name, ("", ""))[0] != moment:
            return df
        day, end = self.days[name][1], (last or first).end
        return df.where(f"{day} >= date'{first.start.date()}' and {day} <= date'{end.date()}'")

    @classmethod
    def from_parquet(
        cls, spark: SparkSession, folder: str, days: dict[str, tuple[str, str]] | None = None
    ) -> Tables:
        """Read `<folder>/<table>` (a Parquet file or directory) for each table.

        `days` names, for tables partitioned by UTC day, the timestamp column and the date
        column made of it, as in {"purchased_packages": ("purchased_at", "day")}.
        """
        read = {name: spark.read.parquet(f"{folder}/{name}") for name in REQUIRED_COLUMNS}
        return cls(**read, days=days or {})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Tables:
        return cls(**{name: spark.table(f"{database}.{name}") for name in REQUIRED_COLUMNS})

    def store_bucketed(self, database: str, buckets: int) -> Tables:
        """Store the tables in a catalog database, replacing earlier ones, and return them from there.

        Histories are divided by user or customer into so many buckets, so joins and groups by these need
        no exchange; choose as many as a task's share of the largest table asks for. A user with a
        large share of the rows has them in one bucket: leave such tables undivided.
        """
        for name in REQUIRED_COLUMNS:
            writer = getattr(self, name).write.mode("overwrite")
            if name in BUCKETS:
                writer = writer.bucketBy(buckets, BUCKETS[name]).sortBy(BUCKETS[name])
            writer.saveAsTable(f"{database}.{name}")
        return Tables.from_catalog(self.users.sparkSession, database)
