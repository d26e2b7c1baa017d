"""Explicit schemas of the warehouse relations and of the exception frame."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_LONG, _INT, _DBL, _STR = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()

_READ_KEY = {"meter_id": _LONG, "channel_id": _INT, "read_dtm": _TS}

WAREHOUSE_SCHEMAS: dict[str, T.StructType] = {
    "registerreads": _struct(**_READ_KEY, status=_INT, read_version=_INT, read_value=_DBL, uom=_STR),
    "registerreads_history": _struct(**_READ_KEY, read_version=_INT, status=_INT),
    "registerreads_deleted": _struct(**_READ_KEY, read_value=_DBL, status=_INT),
    "registerreadcomments": _struct(**_READ_KEY, comments=_STR),
    "registerreadcomments_deleted": _struct(**_READ_KEY, comments=_STR),
    "meter_location_xref": _struct(meter_id=_LONG, location_no=_LONG, active_dt=_TS, inactive_dt=_TS),
    "locations": _struct(location_no=_LONG, location_class=_STR, billing_cycle=_INT),
    "meters": _struct(meter_id=_LONG, meter_tp=_STR),
    "billing_schedule": _struct(
        billing_cycle=_INT, period_start_dt=_DATE, period_end_dt=_DATE, bill_dt=_DATE
    ),
}

# Columns of an extracted exception, in output order.
EXCEPTION_SCHEMA = _struct(
    METER_ID=_LONG, LOCATION_NO=_LONG, LOCATION_CLASS=_STR, BILLING_CYCLE=_INT,
    YEAR=_INT, MONTH=_INT, DAY=_INT, DOW=_STR, COMMENTS=_STR,
    READ_VALUE=_DBL, PREV_READ=_DBL, PREV_READ2=_DBL,
    PREVYEAR=_INT, PREVMONTH=_INT, PREVDAY=_INT, PREVDOW=_STR, PREV_UOM=_STR,
    PREVPREVYEAR=_INT, PREVPREVMONTH=_INT, PREVPREVDAY=_INT, PREVPREVDOW=_STR, PREVPREV_UOM=_STR,
    UOM=_STR, PREV_STATUS=_INT, PREV_STATUS2=_INT,
    NEXTYEAR=_INT, NEXTMONTH=_INT, NEXTDAY=_INT, NEXTDOW=_STR, NEXT_UOM=_STR,
    NEXT_STATUS=_INT, NEXT_READ_VALUE=_DBL, DAYS_FROM_BILLDT=_DBL,
    HILO=_INT, REGISTERINCREASING=_INT, SUMCHECK=_INT, MAXDAILYUSAGE=_INT,
    METER_TP=_STR, READ_HR=_INT, READ_MIN=_INT, READ_SECOND=_INT,
)

# The first column set knew no next read, no unit of the previous read, no meter
# type and no clock time.
_SECOND_VERSION_ONLY = {
    "PREV_UOM", "PREVPREV_UOM", "NEXTYEAR", "NEXTMONTH", "NEXTDAY", "NEXTDOW", "NEXT_UOM",
    "NEXT_STATUS", "NEXT_READ_VALUE", "METER_TP", "READ_HR", "READ_MIN", "READ_SECOND",
}


def exception_columns(version: int = 2) -> list[str]:
    if version == 2:
        return EXCEPTION_SCHEMA.fieldNames()
    if version == 1:
        return [c for c in EXCEPTION_SCHEMA.fieldNames() if c not in _SECOND_VERSION_ONLY]
    raise ValueError(f"unknown column version {version}")
