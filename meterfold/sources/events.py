"""The event table on disk: Parquet, partitioned by month, sorted by project and time within files."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold.functions.predicates import Period, within
from meterfold.schema import EVENT, conform_events


def with_month(events: DataFrame) -> DataFrame:
    return events.withColumn("event_month", F.trunc("ts", "MM"))


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with event_month so dealt that a month's meet in as many tasks as AQE finds fit, so that files aren't tiny."""
    return rows.hint("rebalance", "event_month").sortWithinPartitions("event_month", *order)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events to their months."""
    write_dealt(dealt(with_month(conform_events(events)), "project_id", "ts"), path, mode)


def write_dealt(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append events that are dealt already: they go to disk as they lie."""
    rows.write.mode(mode).partitionBy("event_month").parquet(path)


def read_events(spark: SparkSession, path: str, project: int | None = None, period: Period | None = None) -> DataFrame:
    """Scan of the event table; a period also prunes the months outside it."""
    schema = T.StructType([*EVENT.fields, T.StructField("event_month", T.DateType())])
    rows = spark.read.schema(schema).parquet(path)
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    return rows if period is None else rows.where(within(period))


def expired_months(events: DataFrame, today: datetime.date, days: int) -> DataFrame:
    """Months that ended as a whole before today less so many days."""
    return events.select("event_month").distinct().where(F.add_months("event_month", 1) <= F.date_sub(F.lit(today), days))


def drop_months(spark: SparkSession, path: str, months: list[datetime.date]) -> None:
    """Delete the folders of months, through Hadoop's file system, so that it works on any store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for m in months:
        folder = hadoop(f"{path}/event_month={m.isoformat()}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
