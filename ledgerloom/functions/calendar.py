"""Working days from a calendar table: one row for each day of the configured range.

The table's size is fixed by the configured range (some thousand days), which
is the bound that its broadcasts rest on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FIXED_HOLIDAYS, Config


def calendar(spark: SparkSession, config: Config) -> DataFrame:
    """(day, is_working, before): working days from the start to the day before."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(config.calendar_start)), F.to_date(F.lit(config.calendar_end)))).alias("day"))
    closed = F.weekday("day") >= 5
    if config.national_holidays:
        closed |= F.date_format("day", "MM-dd").isin(*FIXED_HOLIDAYS)
    if config.extra_holidays:
        closed |= F.col("day").isin(*[F.to_date(F.lit(d)) for d in config.extra_holidays])
    days = days.withColumn("is_working", ~closed)
    before = F.sum(F.col("is_working").cast("int")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return days.withColumn("before", F.coalesce(before, F.lit(0)).cast("bigint"))


def in_range(day: Column, config: Config) -> Column:
    """The day, or an error if the calendar doesn't cover it."""
    inside = day.isNull() | day.between(F.to_date(F.lit(config.calendar_start)), F.to_date(F.lit(config.calendar_end)))
    return F.when(inside, day).otherwise(F.raise_error(F.concat(F.lit("the calendar doesn't cover "), day.cast("string"))).cast("date"))


def with_lag(df: DataFrame, days: DataFrame, start: str, end: str, name: str = "lag_days") -> DataFrame:
    """Working days in [start, end); negative if reversed."""
    first = F.broadcast(days.select(F.col("day").alias(start), F.col("before").alias("_first")))
    last = F.broadcast(days.select(F.col("day").alias(end), F.col("before").alias("_last")))
    return df.join(first, start, "left").join(last, end, "left").withColumn(name, F.col("_last") - F.col("_first")).drop("_first", "_last")


def add_working_days(df: DataFrame, days: DataFrame, start: str, n: str, name: str) -> DataFrame:
    """The n-th working day on from ``start``; a closed day first rolls forward without using one up."""
    before = F.broadcast(days.select(F.col("day").alias(start), F.col("before").alias("_at")))
    nth = F.broadcast(days.where("is_working").select(F.col("day").alias(name), F.col("before").alias("_nth")))
    wanted = F.when(F.col(n) < 0, F.raise_error(F.lit("days to add can't be negative")).cast("bigint")).otherwise(F.col("_at") + F.col(n))
    return df.join(before, start, "left").withColumn("_nth", wanted).join(nth, "_nth", "left").drop("_nth", "_at")
