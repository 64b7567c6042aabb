"""A table of days that can be purged without touching a file.

Rows lie in one folder per day. A purge enters a first day to keep into the commit list beside the table; readers that start after it read only
the folders from that day on (partition pruning, no file of an older day is listed as input), readers that started before it finish on
the files they planned. `vacuum` deletes the folders of purged days, once purges are older than a grace time that every running reader fits
into. A purge is one small row, whatever the size of the days it drops.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hireatlas.sources.readers import read_optional

COMMIT = "first_day date, purged_at timestamp"
DAY = "day"


def append_days(rows: DataFrame, base: str, ts: str) -> None:
    """Add rows below the folder of their day; rows without a time stay in the folder of no day, which no purge drops."""
    rows.withColumn(DAY, F.to_date(ts)).write.mode("append").partitionBy(DAY).parquet(base.rstrip("/"))


def _commits(spark: SparkSession, base: str) -> DataFrame:
    path = f"{base.rstrip('/')}-purged"
    return spark.createDataFrame([], COMMIT) if read_optional(spark, path) is None else spark.read.schema(COMMIT).parquet(path)


def first_day(spark: SparkSession, base: str) -> datetime.date | None:
    """The first day that is kept; None before any purge."""
    return _commits(spark, base).agg(F.max("first_day")).first()[0]


def _kept(day: Column, first: datetime.date | None) -> Column:
    return F.lit(True) if first is None else day.isNull() | (day >= F.lit(first))


def read_days(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows that are kept, or None when nothing was ever written."""
    rows = read_optional(spark, base.rstrip("/"))
    return None if rows is None else rows.where(_kept(F.col(DAY).cast("date"), first_day(spark, base)))


def _days(spark: SparkSession, base: str) -> list[datetime.date]:
    """Days that have a folder, from the listing alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    days = [n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=")]
    return sorted(datetime.date.fromisoformat(d) for d in days if not d.startswith("__"))


def purge(spark: SparkSession, base: str, as_of: datetime.date, max_age_days: int) -> list[datetime.date]:
    """Drop the days that are more than ``max_age_days`` before ``as_of``; returns them. A later first day is never taken back."""
    first, before = as_of - datetime.timedelta(days=max_age_days), first_day(spark, base)
    dropped = [d for d in _days(spark, base) if d < first and (before is None or d >= before)]
    if before is None or first > before:
        row = spark.range(1).select(F.lit(first).alias("first_day"), F.current_timestamp().alias("purged_at"))
        row.coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}-purged")
    return dropped


def vacuum(spark: SparkSession, base: str, grace: datetime.timedelta) -> list[datetime.date]:
    """Delete the folders of days whose purge is at least ``grace`` old; returns them."""
    old = F.col("purged_at") <= F.current_timestamp() - F.expr(f"make_dt_interval(0, 0, 0, {grace.total_seconds()})")
    first = _commits(spark, base).where(old).agg(F.max("first_day")).first()[0]
    gone = [d for d in _days(spark, base) if first is not None and d < first]
    for day in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{DAY}={day.isoformat()}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return gone
