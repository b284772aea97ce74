"""Reports kept by month: `<folder>/<name>/year=…/month=…` in Parquet.

Storing a month again replaces it and leaves the others alone, so a job may be repeated, also after it
failed half-way: rows are first staged beside the table, and the month is only replaced, by dynamic
partition overwrite, when they are complete. So a report may also read what it replaces.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.month import MonthWindow


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def store_month(report: DataFrame, folder: str, name: str, month: MonthWindow) -> None:
    """Replace the month's rows of the stored report; a month without rows is stored as such."""
    clash = {c.lower() for c in report.columns} & {"year", "month"}
    if clash:
        raise ValueError(f"{name} has columns of the partitions: {', '.join(sorted(clash))}")
    spark = report.sparkSession
    staged = f"{folder}/_staged/{name}-{uuid.uuid4().hex}"
    report.write.parquet(staged)
    rows = spark.read.schema(report.schema).parquet(staged)
    if rows.isEmpty():  # dynamic overwrite would leave the old rows of a month that has none
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/year={month.year}/month={month.month}")
        return
    kept = rows.withColumn("year", F.lit(month.year)).withColumn("month", F.lit(month.month))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(f"{folder}/{name}")


def stored(spark: SparkSession, folder: str, name: str, *months: MonthWindow) -> DataFrame:
    """The stored rows with `year` and `month`: of the given months, which prunes partitions, or of all."""
    rows = spark.read.parquet(f"{folder}/{name}")
    if not months:
        return rows
    return rows.where(" or ".join(f"(year = {m.year} and month = {m.month})" for m in months))
