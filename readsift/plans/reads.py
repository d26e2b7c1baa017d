"""Extraction of read exceptions and their context."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from readsift import config
from readsift.functions.calendar import calendar_columns, clock_hour, clock_second, day_of, ntz, rounded_days
from readsift.functions.comments import not_automatic, rule_flags, says_accepted
from readsift.operators.asof import neighbour_instants
from readsift.operators.interval import earliest_by_day, join_in_force, time_span
from readsift.operators.rank import spread_sort
from readsift.schemas import exception_columns
from readsift.session import stage
from readsift.sources.tables import Warehouse

READ_KEY = ["meter_id", "channel_id", "read_dtm"]
_TIMELINE = READ_KEY[:2]
#: Rows (meter, channel) of 12 bytes that are sent to every task to prune the reads.
MAX_BROADCAST_LINES = 500_000


def _since(since: datetime):
    return F.col("read_dtm") >= ntz(since)


def failed_keys(wh: Warehouse, since: datetime = config.DEFAULT_SINCE) -> DataFrame:
    """Distinct keys of reads that failed when first stored or still fail."""
    at_first = wh.registerreads_history.where(
        (F.col("read_version") == config.FIRST_READ_VERSION)
        & _since(since)
        & (F.col("status") == config.STATUS_FAILED)
    )
    still = wh.registerreads.where(_since(since) & (F.col("status") == config.STATUS_FAILED))
    return at_first.select(*READ_KEY).unionByName(still.select(*READ_KEY)).distinct()


def current_reads(
    wh: Warehouse,
    since: datetime = config.DEFAULT_SINCE,
    statuses: tuple[int, ...] | None = None,
) -> DataFrame:
    """Current version of the failed reads with each operator comment on them.

    The failed keys are distinct, so a semi join keeps the multiplicity; the date
    cut-off of the keys is repeated on the other inputs to prune their scans.
    """
    reads = wh.registerreads.where(_since(since))
    if statuses is not None:
        reads = reads.where(F.col("status").isin(*statuses))
    notes = wh.registerreadcomments.where(_since(since) & not_automatic(F.col("comments")))
    return (
        reads.select(*READ_KEY, "status", "read_version", "read_value")
        .join(failed_keys(wh, since), READ_KEY, "left_semi")
        .join(notes, READ_KEY)
    )


_READ_COLUMNS = [*READ_KEY, "read_value", "comments"]


def accepted_exceptions(wh: Warehouse, since: datetime = config.DEFAULT_SINCE) -> DataFrame:
    """Failed reads an operator accepted by hand."""
    current = current_reads(wh, since, (config.STATUS_ACCEPTED,))
    return current.where(says_accepted(F.col("comments"))).select(*_READ_COLUMNS)


def failed_exceptions(wh: Warehouse, since: datetime = config.DEFAULT_SINCE) -> DataFrame:
    """Reads that still fail validation.

    A read with the failed status is in the failed keys itself, so the key set
    need not be joined.
    """
    failed = wh.registerreads.where(_since(since) & (F.col("status") == config.STATUS_FAILED))
    notes = wh.registerreadcomments.where(_since(since) & not_automatic(F.col("comments")))
    return failed.join(notes, READ_KEY).select(*_READ_COLUMNS)


def deleted_exceptions(wh: Warehouse, since: datetime = config.DEFAULT_SINCE) -> DataFrame:
    """Deleted reads that had failed, with every comment, also a NULL one."""
    deleted = wh.registerreads_deleted.where(_since(since) & (F.col("status") == config.STATUS_FAILED))
    notes = wh.registerreadcomments_deleted.where(_since(since))
    return deleted.join(notes, READ_KEY).select(*_READ_COLUMNS)


def _neighbour(reads: DataFrame, which: str, **columns: str) -> DataFrame:
    renamed = [F.col(source).alias(target) for target, source in columns.items()]
    return reads.select(*_TIMELINE, F.col("read_dtm").alias(f"{which}_read_dtm"), *renamed)


def _payload_at(reads: DataFrame, instants: DataFrame, wanted: list[str]) -> DataFrame:
    """Reads at any of the wanted neighbour instants, staged: the big relation is
    shuffled once for this, and the few rows kept are joined from the copy."""
    needed = (
        instants.select(*_TIMELINE, F.explode(F.array(*wanted)).alias("read_dtm"))
        .where(F.col("read_dtm").isNotNull())
        .distinct()
    )
    # The ends of the wanted instants prune the scan before the join does.
    ends = instants.agg(F.min(F.least(*wanted)).alias("lo"), F.max(F.greatest(*wanted)).alias("hi")).first()
    held = reads.where(F.col("read_dtm").between(ntz(ends["lo"]), ntz(ends["hi"]))).select(*READ_KEY, "read_value", "uom", "status")
    return stage(held.join(needed, READ_KEY, "left_semi"), "neighbour-reads")


def with_read_context(
    exceptions: DataFrame,
    wh: Warehouse,
    version: int = 2,
    keep: tuple[str, ...] = (),
    slice_of: Callable[[Column], Column] = day_of,
) -> DataFrame:
    """Widen exceptions by neighbour reads, location, meter type, billing and flags.

    An exception without a previous, second-previous or (version 2) next read,
    without a location in force or (version 2) a meter type is dropped; several
    matches fan out. ``keep`` names extra input columns to carry, in front. ``slice_of`` cuts
    the timelines, days by default; a key with many reads a day wants a finer one.
    """
    columns = exception_columns(version)
    exceptions = stage(exceptions, "exceptions")
    span = time_span(exceptions, "read_dtm")

    # Only timelines that hold an exception can matter. Few of them prune the reads before any shuffle; where
    # there are more than a broadcast should carry, most timelines matter and all reads go the same way.
    lines = stage(exceptions.select(*_TIMELINE).distinct(), "timelines")
    base = wh.registerreads
    if lines.count() <= MAX_BROADCAST_LINES:
        base = base.join(F.broadcast(lines), _TIMELINE, "left_semi")
    instants = neighbour_instants(exceptions, base, _TIMELINE, "read_dtm", slice_of)
    wanted = ["prev_read_dtm", "prev2_read_dtm"] + (["next_read_dtm"] if version == 2 else [])
    complete = instants
    for c in wanted:
        complete = complete.where(F.col(c).isNotNull())
    instants = stage(complete.select(*READ_KEY, *wanted), "neighbour-instants")
    payload = _payload_at(wh.registerreads, instants, wanted)

    rows = (
        exceptions.join(instants, READ_KEY)
        .join(
            _neighbour(payload, "prev", PREV_READ="read_value", UOM="uom", PREV_STATUS="status"),
            [*_TIMELINE, "prev_read_dtm"],
        )
        .join(
            _neighbour(payload, "prev2", PREV_READ2="read_value", PREVPREV_UOM="uom", PREV_STATUS2="status"),
            [*_TIMELINE, "prev2_read_dtm"],
        )
    )
    if version == 2:
        rows = rows.join(
            _neighbour(payload, "next", NEXT_READ_VALUE="read_value", NEXT_UOM="uom", NEXT_STATUS="status"),
            [*_TIMELINE, "next_read_dtm"],
        ).join(wh.meters.withColumnRenamed("meter_tp", "METER_TP"), "meter_id")

    rows = join_in_force(
        rows, wh.meter_location_xref, "meter_id", "read_dtm", "active_dt", "inactive_dt", span
    ).join(wh.locations, "location_no")

    bill = earliest_by_day(
        wh.billing_schedule, "billing_cycle", "period_start_dt", "period_end_dt", "bill_dt", span
    )
    rows = rows.withColumn("day", day_of(F.col("read_dtm"))).join(bill, ["billing_cycle", "day"], "left")

    ts, comment = F.col("read_dtm"), F.col("comments")
    made = {
        **calendar_columns("", ts),
        **calendar_columns("PREV", F.col("prev_read_dtm")),
        **calendar_columns("PREVPREV", F.col("prev2_read_dtm")),
        "DAYS_FROM_BILLDT": rounded_days(ts, F.col("bill_dt")),
        **rule_flags(comment),
    }
    if version == 2:
        made |= calendar_columns("NEXT", F.col("next_read_dtm"))
        made |= {
            # The unit is taken from the previous read under both names.
            "PREV_UOM": F.col("UOM"),
            "READ_HR": clock_hour(ts),
            "READ_MIN": F.minute(ts),
            "READ_SECOND": clock_second(ts),
        }
    return rows.select(*keep, *[made.get(c, F.col(c.lower() if c in _LOWER else c)).alias(c) for c in columns])


# Output columns taken unchanged from a relation column of the same name.
_LOWER = {"METER_ID", "LOCATION_NO", "LOCATION_CLASS", "BILLING_CYCLE", "COMMENTS", "READ_VALUE"}


def in_time_order(df: DataFrame, sort: bool) -> DataFrame:
    return spread_sort(df, "read_dtm").drop("read_dtm") if sort else df


def _extract(exceptions, wh, version, sort) -> DataFrame:
    keep = ("read_dtm",) if sort else ()
    return in_time_order(with_read_context(exceptions, wh, version, keep), sort)


def accepted_reads(wh, since=config.DEFAULT_SINCE, version=2, sort=False) -> DataFrame:
    return _extract(accepted_exceptions(wh, since), wh, version, sort)


def failed_reads(wh, since=config.DEFAULT_SINCE, version=2, sort=False) -> DataFrame:
    return _extract(failed_exceptions(wh, since), wh, version, sort)


def deleted_reads(wh, since=config.DEFAULT_SINCE, version=2, sort=False) -> DataFrame:
    return _extract(deleted_exceptions(wh, since), wh, version, sort)


def labelled_reads(wh: Warehouse, since=config.DEFAULT_SINCE, version=2, keep: tuple[str, ...] = ()) -> DataFrame:
    """All exceptions with ``Status`` 1 (accepted) or 0 (still failing or deleted).

    The three sets are stacked before the context is added, so the timeline of
    all reads is shuffled once, not three times.
    """
    label = config.TARGET_COLUMN
    stacked = (
        accepted_exceptions(wh, since).withColumn(label, F.lit(1))
        .unionByName(failed_exceptions(wh, since).withColumn(label, F.lit(0)))
        .unionByName(deleted_exceptions(wh, since).withColumn(label, F.lit(0)))
    )
    wide = with_read_context(stacked, wh, version, (*keep, label))
    return wide.select(*keep, *exception_columns(version), label)
