"""The monitoring dashboard's questions as parameterised plans over flows and detections.

Flows have time, ip_src, ip_dst, protocol, in_bytes, in_pkts; detections have flow_id, detector, event_name, metric and event_time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(rows: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """An open bound filters nothing, so that the predicate reaches the scan only when it is asked for."""
    if start:
        rows = rows.where(F.col(time) >= F.to_timestamp(F.lit(start)))
    return rows.where(F.col(time) <= F.to_timestamp(F.lit(end))) if end else rows


def equals(rows: DataFrame, **wanted: str) -> DataFrame:
    """Optional equality filters; an empty value disables one."""
    for column, value in wanted.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def interval(time: str, seconds: int) -> Column:
    return F.window(F.col(time), f"{seconds} seconds")["start"]


def detections_total(detections: DataFrame) -> DataFrame:
    return detections.agg(F.count("*").alias("detections"))


def per_interval(rows: DataFrame, time: str, seconds: int, *by: str, limit: int | None = None) -> DataFrame:
    """Rows per time interval and group, in order; the limit is the panel's."""
    out = rows.groupBy(interval(time, seconds).alias("time"), *by).agg(F.count("*").alias("n")).orderBy("time", *by)
    return out.limit(limit) if limit else out


def top(rows: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """The most frequent values: a partial aggregation and a bounded heap per task."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def top_per_interval(rows: DataFrame, time: str, seconds: int, by: str, volume: str, limit: int = 10) -> DataFrame:
    """The groups with the greatest volume of each interval."""
    sums = rows.groupBy(interval(time, seconds).alias("time"), by).agg(F.sum(volume).alias("volume"))
    order = Window.partitionBy("time").orderBy(F.desc("volume"), by)
    return sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


def rate_per_minute(rows: DataFrame, time: str, amount: Column | None = None, *by: str) -> DataFrame:
    """Per-second rate of each minute: the amount (default: rows) over 60."""
    value = F.count("*") if amount is None else F.sum(amount)
    return rows.groupBy(F.date_trunc("minute", F.col(time)).alias("time"), *by).agg((value / F.lit(60.0)).alias("per_second"))


def bytes_per_second(flows: DataFrame, time: str, size: str, protocols: tuple[int, ...], negate: bool = False) -> DataFrame:
    hit = F.col("protocol").isin(*protocols)
    return rate_per_minute(flows.where(~hit if negate else hit), time, F.col(size))
