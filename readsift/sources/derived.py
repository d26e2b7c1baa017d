"""A warehouse derived from the driver's ``events``, ``customer`` and ``nation``.

The given tables hold no meter reads. Each event becomes a read, and residues of
its id decide which role it plays (read, deleted read, status, comment text), so
every event is used and all relations grow with ``events``. The hard cases are
kept on purpose: repeated read keys, NULL and repeated comments, reads on an
interval edge, uncovered and doubly covered billing days.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from readsift.functions.calendar import ntz
from readsift.sources.given import given
from readsift.sources.tables import Warehouse

SINCE = datetime(2024, 1, 3)
_OPENED = datetime(2023, 12, 1)
_CLOSED = datetime(2024, 1, 29)
_KEY = ("meter_id", "channel_id", "read_dtm")

# Comment text by event_id % 6; residue 5 has none.
_COMMENTS = (
    "HiLo: out of range. Accepted by operator",
    "RegisterIncreasing: decreased. Accepted",
    "SumCheck: HiLo: Accepted after check",
    "MaxDailyUsage: exceeded",
    "Automatically Accepted",
)
# Meter type by meter_id % 4.
_METER_TYPES = ("8/9SD", "2SD", "15/16SD", "2SE")


def _by_residue(column: str, modulus: int, values: tuple[str, ...]):
    residue = F.col(column) % modulus
    chosen = F.when(residue == 0, values[0])
    for i, value in enumerate(values[1:], start=1):
        chosen = chosen.when(residue == i, value)
    return chosen


def _int(value: int):
    return F.lit(value).cast("int")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("user_id").alias("meter_id"),
        F.col("ts").alias("read_dtm"),
        F.col("value").alias("read_value"),
        F.when(kind.isin("click", "view"), 1).when(kind == "error", 2).otherwise(3).alias("channel_id"),
        F.when(kind == "error", "KWH_TOU_RATE_B").otherwise("KWH").alias("uom"),
    )


def derived_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    ev = _reads(spark, sf_dir)
    event_id = F.col("event_id")
    deleted = event_id % 10 == 9

    first_values = ev.where(~deleted).select(
        *_KEY, "read_value", "uom",
        _int(2).alias("read_version"),
        F.when(event_id % 7 == 0, 2).when((event_id % 7).isin(1, 2), 5).otherwise(1).alias("status"),
    )
    corrected = ev.where(event_id % 97 == 5).select(
        *_KEY, (F.col("read_value") + 1).alias("read_value"), "uom",
        _int(3).alias("read_version"), _int(1).alias("status"),
    )

    comments = ev.withColumn("comments", _by_residue("event_id", 6, _COMMENTS)).select("event_id", *_KEY, "comments")
    second_notes = ev.where(event_id % 11 == 0).select(
        "event_id", *_KEY, F.lit("hilo: second note. Accepted").alias("comments")
    )
    all_comments = comments.unionByName(second_notes)

    moves = ev.groupBy("meter_id").agg(F.min(F.when(event_id % 5 == 2, F.col("read_dtm"))).alias("edge"))
    xref = moves.select(
        "meter_id", F.col("meter_id").alias("location_no"),
        ntz(_OPENED).alias("active_dt"), F.col("edge").alias("inactive_dt"),
    ).unionByName(
        moves.select(
            "meter_id", (F.col("meter_id") + 1).alias("location_no"),
            F.col("edge").alias("active_dt"), ntz(_CLOSED).alias("inactive_dt"),
        )
    )

    week = F.explode(F.array(*[F.lit(7 * k) for k in range(5)]))
    opening = F.lit("2024-01-01").cast("date")
    schedule = given(spark, sf_dir, "nation").select("n_nationkey", week.alias("shift")).select(
        F.col("n_nationkey").alias("billing_cycle"),
        F.date_add(opening, F.col("shift")).alias("period_start_dt"),
        F.date_add(opening, F.col("shift") + F.when(F.col("n_nationkey") % 3 == 0, 5).otherwise(7)).alias("period_end_dt"),
        F.date_add(opening, F.col("shift") + 10).alias("bill_dt"),
    )

    return Warehouse(
        registerreads=first_values.unionByName(corrected),
        registerreads_history=ev.where(~deleted & (event_id % 3 == 0)).select(
            *_KEY, _int(1).alias("read_version"), _int(2).alias("status")
        ),
        registerreads_deleted=ev.where(deleted).select(
            *_KEY, "read_value", F.when(event_id % 4 == 3, 1).otherwise(2).alias("status")
        ),
        registerreadcomments=all_comments.where(~deleted).drop("event_id"),
        registerreadcomments_deleted=all_comments.where(deleted).drop("event_id"),
        meter_location_xref=xref,
        locations=given(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("location_no"),
            F.col("c_mktsegment").alias("location_class"),
            F.col("c_nationkey").alias("billing_cycle"),
        ),
        meters=ev.where(F.col("meter_id") % 13 != 12)
        .select("meter_id").distinct()
        .withColumn("meter_tp", _by_residue("meter_id", 4, _METER_TYPES)),
        billing_schedule=schedule,
    )
