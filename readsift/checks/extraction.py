"""Scan, filter, join, set and extraction queries on the derived warehouse."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from readsift.checks.registering import Book
from readsift.checks.warehouse_sql import PROBES, SINCE as SINCE_SQL, extraction, lookup, warehouse_query
from readsift.functions import calendar
from readsift.functions.comments import not_automatic, rule_flags, says_accepted
from readsift.operators.asof import asof_backward, asof_forward, asof_second_backward, neighbour_instants
from readsift.operators.interval import earliest_by_day, join_in_force, time_span
from readsift.plans import reads
from readsift.sources.derived import SINCE, derived_warehouse
from readsift.sources.given import given

_KEY = ["meter_id", "channel_id", "read_dtm"]
_LINE = _KEY[:2]

BOOK = Book()
query = BOOK.query


def _since():
    return F.col("read_dtm") >= calendar.ntz(SINCE)


_TABLES = (
    "registerreads registerreads_history registerreads_deleted registerreadcomments "
    "registerreadcomments_deleted meter_location_xref locations meters billing_schedule"
).split()


@query(
    warehouse_query(
        " UNION ALL ".join(f"SELECT '{t}' AS relation, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in _TABLES)
    )
)
def scan_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        for name, df in derived_warehouse(spark, sf_dir).tables().items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    warehouse_query(
        f"SELECT status, CAST(count(*) AS BIGINT) AS n, min(read_dtm) AS first_dtm FROM registerreads "
        f"WHERE read_dtm >= {SINCE_SQL} GROUP BY status"
    )
)
def filter_date_cutoff(spark, sf_dir):
    wh = derived_warehouse(spark, sf_dir)
    return wh.registerreads.where(_since()).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("read_dtm").alias("first_dtm")
    )


@query(
    warehouse_query(
        "SELECT meter_id, channel_id, read_dtm, read_version, status FROM registerreads_history "
        "WHERE read_version = 1 AND status = 2"
    )
)
def filter_status_version(spark, sf_dir):
    history = derived_warehouse(spark, sf_dir).registerreads_history
    return history.where((F.col("read_version") == 1) & (F.col("status") == 2))


@query(warehouse_query("SELECT * FROM registerreadcomments WHERE comments NOT LIKE '%Automatically%'"))
def filter_not_automatic(spark, sf_dir):
    notes = derived_warehouse(spark, sf_dir).registerreadcomments
    return notes.where(not_automatic(F.col("comments")))


@query(warehouse_query("SELECT * FROM registerreadcomments WHERE comments LIKE '%Accepted%'"))
def filter_accepted_comment(spark, sf_dir):
    notes = derived_warehouse(spark, sf_dir).registerreadcomments
    return notes.where(says_accepted(F.col("comments")))


@query(
    warehouse_query(
        "SELECT * FROM registerreads WHERE CAST(read_dtm AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'"
    )
)
def filter_day_between(spark, sf_dir):
    wh = derived_warehouse(spark, sf_dir)
    day = calendar.day_of(F.col("read_dtm"))
    first, last = F.lit("2024-01-08").cast("date"), F.lit("2024-01-15").cast("date")
    return wh.registerreads.where(day.between(first, last))


@query(
    warehouse_query(
        "SELECT meter_id AS METER_ID, read_dtm AS READ_DTM, read_value AS READ_VALUE, uom AS PREV_UOM, uom AS UOM FROM registerreads"
    )
)
def project_rename(spark, sf_dir):
    r = derived_warehouse(spark, sf_dir).registerreads
    return r.select(
        F.col("meter_id").alias("METER_ID"), F.col("read_dtm").alias("READ_DTM"),
        F.col("read_value").alias("READ_VALUE"), F.col("uom").alias("PREV_UOM"), F.col("uom").alias("UOM"),
    )


_MARKS = (("HILO", "HiLo:"), ("REGISTERINCREASING", "RegisterIncreasing:"), ("SUMCHECK", "SumCheck:"), ("MAXDAILYUSAGE", "MaxDailyUsage:"))


@query(
    warehouse_query(
        "SELECT meter_id, channel_id, read_dtm, comments, "
        + ", ".join(f"CASE WHEN strpos(comments, '{m}') > 0 THEN 1 ELSE 0 END AS {n}" for n, m in _MARKS)
        + " FROM (SELECT * FROM registerreadcomments UNION ALL SELECT * FROM registerreadcomments_deleted)"
    )
)
def rule_flag_columns(spark, sf_dir):
    wh = derived_warehouse(spark, sf_dir)
    notes = wh.registerreadcomments.unionByName(wh.registerreadcomments_deleted)
    return notes.withColumns(rule_flags(F.col("comments")))


@query(warehouse_query("SELECT meter_id, channel_id, read_dtm FROM failed_keys", PROBES["accepted"]))
def failed_keys(spark, sf_dir):
    return reads.failed_keys(derived_warehouse(spark, sf_dir), SINCE)


@query(
    warehouse_query(
        "SELECT meter_id, channel_id, read_dtm, status, read_version, read_value, comments FROM current_reads",
        PROBES["accepted"],
    )
)
def current_failed_reads(spark, sf_dir):
    return reads.current_reads(derived_warehouse(spark, sf_dir), SINCE)


@query(warehouse_query("SELECT meter_id, channel_id, read_dtm, read_value, comments FROM deleted", PROBES["deleted"]))
def deleted_with_comments(spark, sf_dir):
    return reads.deleted_exceptions(derived_warehouse(spark, sf_dir), SINCE)


@query(
    warehouse_query(
        "SELECT meter_id, channel_id, read_dtm, d.read_value, r.meter_tp FROM (SELECT meter_id, channel_id, read_dtm, read_value FROM registerreads "
        "UNION ALL SELECT meter_id, channel_id, read_dtm, read_value FROM registerreads_deleted) d JOIN meters r USING (meter_id)"
    )
)
def join_meter_type(spark, sf_dir):
    wh = derived_warehouse(spark, sf_dir)
    values = [*_KEY, "read_value"]
    every = wh.registerreads.select(*values).unionByName(wh.registerreads_deleted.select(*values))
    return every.join(wh.meters, "meter_id").select(*values, "meter_tp")


def _asof_inputs(spark, sf_dir):
    wh = derived_warehouse(spark, sf_dir)
    base = wh.registerreads.select(*_KEY, "read_value", "status")
    probes = wh.registerreads.select(*_KEY).unionByName(wh.registerreads_deleted.select(*_KEY))
    return probes.distinct(), base


def _asof_sql(which: str, looked_up: str) -> str:
    return warehouse_query(
        f"SELECT p.meter_id, p.channel_id, p.read_dtm, {which}_dtm AS {which}_read_dtm, "
        f"b.read_value AS {which}_read_value, b.status AS {which}_status "
        f"FROM (SELECT DISTINCT meter_id, channel_id, read_dtm FROM ev) p {looked_up} JOIN registerreads b ON b.meter_id = p.meter_id "
        f"AND b.channel_id = p.channel_id AND b.read_dtm = {which}_dtm"
    )


@query(_asof_sql("prev", lookup("p", "max", "<", "p.read_dtm", "prev_dtm")))
def asof_previous(spark, sf_dir):
    return asof_backward(*_asof_inputs(spark, sf_dir), _LINE, "read_dtm")


@query(
    _asof_sql(
        "prev2",
        lookup("p", "max", "<", "p.read_dtm", "prev_dtm") + " " + lookup("p", "max", "<", "prev_dtm", "prev2_dtm"),
    )
)
def asof_second_previous(spark, sf_dir):
    return asof_second_backward(*_asof_inputs(spark, sf_dir), _LINE, "read_dtm")


@query(_asof_sql("next", lookup("p", "min", ">", "p.read_dtm", "next_dtm")))
def asof_next(spark, sf_dir):
    return asof_forward(*_asof_inputs(spark, sf_dir), _LINE, "read_dtm")


@query(
    warehouse_query(
        "SELECT p.meter_id, p.channel_id, p.read_dtm, prev_dtm AS prev_read_dtm, prev2_dtm AS prev2_read_dtm, "
        "next_dtm AS next_read_dtm FROM (SELECT DISTINCT meter_id, channel_id, read_dtm FROM ev) p "
        + " ".join(
            (
                lookup("p", "max", "<", "p.read_dtm", "prev_dtm"),
                lookup("p", "max", "<", "prev_dtm", "prev2_dtm"),
                lookup("p", "min", ">", "p.read_dtm", "next_dtm"),
            )
        )
    )
)
def neighbour_reads(spark, sf_dir):
    """Neighbours of every read, kept or deleted."""
    wh = derived_warehouse(spark, sf_dir)
    probes = wh.registerreads.select(*_KEY).unionByName(wh.registerreads_deleted.select(*_KEY))
    return neighbour_instants(probes, wh.registerreads, _LINE, "read_dtm")


@query(
    warehouse_query(
        "SELECT p.meter_id, p.channel_id, p.read_dtm, p.read_value, p.status, p.read_version, p.uom, x.location_no "
        "FROM registerreads p JOIN meter_location_xref x ON x.meter_id = p.meter_id "
        "AND x.active_dt <= p.read_dtm AND x.inactive_dt > p.read_dtm"
    )
)
def location_in_force(spark, sf_dir):
    wh = derived_warehouse(spark, sf_dir)
    span = time_span(wh.registerreads, "read_dtm")
    return join_in_force(
        wh.registerreads, wh.meter_location_xref, "meter_id", "read_dtm", "active_dt", "inactive_dt", span
    )


def _reads_with_cycle(wh):
    return wh.registerreads.select(*_KEY, "read_value", (F.col("meter_id") % 30).cast("int").alias("billing_cycle"))


@query(
    warehouse_query(
        "SELECT p.*, CAST(round((epoch_us(CAST((SELECT min(s.bill_dt) FROM billing_schedule s WHERE s.billing_cycle = p.billing_cycle "
        "AND CAST(p.read_dtm AS DATE) BETWEEN s.period_start_dt AND s.period_end_dt) AS TIMESTAMP)) - epoch_us(p.read_dtm)) "
        "/ 86400000000.0) AS DOUBLE) AS days_from_billdt "
        "FROM (SELECT meter_id, channel_id, read_dtm, read_value, CAST(meter_id % 30 AS INT) AS billing_cycle FROM registerreads) p"
    )
)
def days_to_billing(spark, sf_dir):
    """Cycles 25 to 29 have no schedule, so their days stay NULL."""
    wh = derived_warehouse(spark, sf_dir)
    probes = _reads_with_cycle(wh)
    bill = earliest_by_day(
        wh.billing_schedule, "billing_cycle", "period_start_dt", "period_end_dt", "bill_dt",
        time_span(wh.registerreads, "read_dtm"),
    )
    days = calendar.rounded_days(F.col("read_dtm"), F.col("bill_dt"))
    return (
        probes.withColumn("day", calendar.day_of(F.col("read_dtm")))
        .join(bill, ["billing_cycle", "day"], "left")
        .withColumn("days_from_billdt", days)
        .drop("day", "bill_dt")
    )


@query(
    warehouse_query(
        "SELECT meter_id, channel_id, min(read_dtm) AS first_dtm, max(read_dtm) AS last_dtm, "
        "min(read_value) AS min_value, max(read_value) AS max_value FROM registerreads GROUP BY meter_id, channel_id"
    )
)
def meter_extremes(spark, sf_dir):
    return derived_warehouse(spark, sf_dir).registerreads.groupBy(*_LINE).agg(
        F.min("read_dtm").alias("first_dtm"), F.max("read_dtm").alias("last_dtm"),
        F.min("read_value").alias("min_value"), F.max("read_value").alias("max_value"),
    )


@query(
    "SELECT event_id, CAST(year(ts) AS INT) AS yyyy, CAST(month(ts) AS INT) AS mm, CAST(day(ts) AS INT) AS dd FROM events"
)
def fn_calendar_parts(spark, sf_dir):
    ts = F.col("ts")
    events = given(spark, sf_dir, "events")
    return events.select(
        "event_id", F.year(ts).alias("yyyy"), F.month(ts).alias("mm"), F.dayofmonth(ts).alias("dd")
    )


@query("SELECT event_id, upper(strftime(ts, '%a')) AS dow FROM events")
def fn_day_name(spark, sf_dir):
    events = given(spark, sf_dir, "events")
    return events.select("event_id", calendar.day_name(F.col("ts")).alias("dow"))


@query(
    "SELECT event_id, CAST(strftime(ts, '%I') AS INT) AS hh, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS ss FROM events"
)
def fn_clock_parts(spark, sf_dir):
    ts = F.col("ts")
    events = given(spark, sf_dir, "events")
    return events.select(
        "event_id", calendar.clock_hour(ts).alias("hh"), F.minute(ts).alias("mi"),
        calendar.clock_second(ts).alias("ss"),
    )


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def fn_truncate_day(spark, sf_dir):
    events = given(spark, sf_dir, "events")
    return events.select("event_id", calendar.day_of(F.col("ts")).alias("day"))


@query(
    "SELECT event_id, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 86400000000.0 AS days FROM events"
)
def fn_fractional_days(spark, sf_dir):
    events = given(spark, sf_dir, "events")
    mark = calendar.ntz(datetime(2024, 1, 20))
    return events.select("event_id", calendar.days_between(F.col("ts"), mark).alias("days"))


@query(
    "SELECT event_id, round((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 86400000000.0) AS days FROM events"
)
def fn_rounded_days(spark, sf_dir):
    events = given(spark, sf_dir, "events")
    mark = calendar.ntz(datetime(2024, 1, 20))
    return events.select("event_id", calendar.rounded_days(F.col("ts"), mark).alias("days"))


@query(
    warehouse_query(
        "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(comments) AS BIGINT) AS n_null, "
        "CAST(sum(strpos(comments, 'HiLo:')) AS BIGINT) AS hilo_positions FROM registerreadcomments"
    )
)
def fn_instr(spark, sf_dir):
    notes = derived_warehouse(spark, sf_dir).registerreadcomments
    return notes.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count("comments")).alias("n_null"),
        F.sum(F.instr("comments", "HiLo:")).alias("hilo_positions"),
    )


@query(
    warehouse_query(
        "SELECT row_number() OVER (ORDER BY read_dtm, meter_id, channel_id, read_value, uom, read_version, status) - 1 AS row_idx, "
        "meter_id, channel_id, read_dtm, read_value, uom, read_version, status FROM registerreads"
    )
)
def reads_in_time_order(spark, sf_dir):
    """Reads with their place in time order; the place shows the order to an order-blind compare."""
    from readsift.operators.rank import row_index

    r = derived_warehouse(spark, sf_dir).registerreads
    order = ["read_dtm", "meter_id", "channel_id", "read_value", "uom", "read_version", "status"]
    return row_index(r, order, from_scan=True)


@query(extraction("accepted"))
def accepted_reads(spark, sf_dir):
    return reads.accepted_reads(derived_warehouse(spark, sf_dir), SINCE, sort=True)


@query(extraction("failed"))
def failed_reads(spark, sf_dir):
    return reads.failed_reads(derived_warehouse(spark, sf_dir), SINCE, sort=True)


@query(extraction("deleted"))
def deleted_reads(spark, sf_dir):
    return reads.deleted_reads(derived_warehouse(spark, sf_dir), SINCE, sort=True)


@query(extraction("accepted", 1))
def accepted_reads_v1(spark, sf_dir):
    return reads.accepted_reads(derived_warehouse(spark, sf_dir), SINCE, version=1, sort=True)


@query(extraction("failed", 1))
def failed_reads_v1(spark, sf_dir):
    return reads.failed_reads(derived_warehouse(spark, sf_dir), SINCE, version=1, sort=True)


def _labelled_sql() -> str:
    from readsift.schemas import exception_columns

    columns = ", ".join(exception_columns(2))
    return extraction("labelled", 2, f"SELECT {columns}, label AS Status FROM wide")


@query(_labelled_sql())
def labelled_reads(spark, sf_dir):
    return reads.labelled_reads(derived_warehouse(spark, sf_dir), SINCE)


@query(
    extraction("labelled", 2, "SELECT label AS Status, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY label")
)
def stacked_exceptions(spark, sf_dir):
    """Sizes of the stacked exception sets before context is added."""
    wh = derived_warehouse(spark, sf_dir)
    sets = (
        (reads.accepted_exceptions(wh, SINCE), 1),
        (reads.failed_exceptions(wh, SINCE), 0),
        (reads.deleted_exceptions(wh, SINCE), 0),
    )
    stacked = reduce(DataFrame.unionByName, [df.withColumn("Status", F.lit(label)) for df, label in sets])
    return stacked.groupBy("Status").agg(F.count(F.lit(1)).alias("n"))
