"""Point-in-interval joins, turned into equi-joins on calendar slices.

An interval is spread over the slices it touches, clipped to the span the probes
cover, so a slice value joins by hash and only the rows of one (key, slice) meet.
A key that dominates either side is thereby cut by time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from readsift.functions.calendar import ntz


def time_span(df: DataFrame, on: str) -> tuple[datetime | None, datetime | None]:
    """Smallest and largest value of a column: one row, two values."""
    row = df.agg(F.min(on).alias("lo"), F.max(on).alias("hi")).first()
    return row["lo"], row["hi"]


def join_in_force(
    probes: DataFrame,
    intervals: DataFrame,
    by: str,
    on: str,
    start: str,
    end: str,
    span: tuple[datetime | None, datetime | None],
) -> DataFrame:
    """Inner join of each probe to the intervals ``[start, end)`` of its key.

    ``span`` bounds the probes (see :func:`time_span`); it limits how many
    monthly slices an open-ended interval is spread over.
    """
    lo, hi = (ntz(v) for v in span)
    first = F.trunc(F.greatest(F.col(start), lo).cast("date"), "MM")
    last = F.trunc(F.least(F.col(end), hi).cast("date"), "MM")
    spread = (
        intervals.where((F.col(start) < F.col(end)) & (F.col(start) <= hi) & (F.col(end) > lo))
        .withColumn("_slice", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))
        .withColumnRenamed(by, "_by")
    )
    sliced = probes.withColumn("_probe_slice", F.trunc(F.col(on).cast("date"), "MM"))
    condition = (
        (F.col(by) == F.col("_by"))
        & (F.col("_probe_slice") == F.col("_slice"))
        & (F.col(start) <= F.col(on))
        & (F.col(end) > F.col(on))
    )
    return sliced.join(spread, condition).drop("_by", "_slice", "_probe_slice", start, end)


def earliest_by_day(
    periods: DataFrame,
    by: str,
    start: str,
    end: str,
    value: str,
    span: tuple[datetime | None, datetime | None],
) -> DataFrame:
    """Per (key, day) the least ``value`` among the periods covering the day.

    Periods are closed and compare with the day at midnight, as a period that
    starts later on its first day does not cover that day.
    """
    lo, hi = (ntz(v).cast("date") for v in span)
    start_day = F.col(start).cast("date")
    opens = F.when(start_day.cast("timestamp_ntz") < F.col(start).cast("timestamp_ntz"), F.date_add(start_day, 1))
    first = F.greatest(opens.otherwise(start_day), lo)
    last = F.least(F.col(end).cast("date"), hi)
    return (
        periods.withColumn("_from", first)
        .withColumn("_to", last)
        .where(F.col("_from") <= F.col("_to"))
        .withColumn("day", F.explode(F.sequence("_from", "_to", F.expr("INTERVAL 1 DAY"))))
        .groupBy(by, "day")
        .agg(F.min(value).alias(value))
    )
