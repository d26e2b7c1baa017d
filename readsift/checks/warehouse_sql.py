"""Oracle text of the derived warehouse and of the extraction built on it."""

from __future__ import annotations

SINCE = "TIMESTAMP '2024-01-03 00:00:00'"

# The same relations as readsift.sources.derived, as a WITH list.
WAREHOUSE = """
ev AS (
  SELECT event_id, user_id AS meter_id, ts AS read_dtm, value AS read_value,
         CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END AS channel_id,
         CASE WHEN event_type = 'error' THEN 'KWH_TOU_RATE_B' ELSE 'KWH' END AS uom
  FROM events),
registerreads AS (
  SELECT meter_id, channel_id, read_dtm, read_value, uom, CAST(2 AS INT) AS read_version,
         CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 7 IN (1, 2) THEN 5 ELSE 1 END AS status
  FROM ev WHERE event_id % 10 <> 9
  UNION ALL
  SELECT meter_id, channel_id, read_dtm, read_value + 1 AS read_value, uom, CAST(3 AS INT) AS read_version, CAST(1 AS INT) AS status
  FROM ev WHERE event_id % 97 = 5),
registerreads_history AS (
  SELECT meter_id, channel_id, read_dtm, CAST(1 AS INT) AS read_version, CAST(2 AS INT) AS status
  FROM ev WHERE event_id % 10 <> 9 AND event_id % 3 = 0),
registerreads_deleted AS (
  SELECT meter_id, channel_id, read_dtm, read_value, CASE WHEN event_id % 4 = 3 THEN 1 ELSE 2 END AS status
  FROM ev WHERE event_id % 10 = 9),
comment_rows AS (
  SELECT event_id, meter_id, channel_id, read_dtm,
         CASE event_id % 6 WHEN 0 THEN 'HiLo: out of range. Accepted by operator'
                           WHEN 1 THEN 'RegisterIncreasing: decreased. Accepted'
                           WHEN 2 THEN 'SumCheck: HiLo: Accepted after check'
                           WHEN 3 THEN 'MaxDailyUsage: exceeded'
                           WHEN 4 THEN 'Automatically Accepted'
                           ELSE NULL END AS comments
  FROM ev
  UNION ALL
  SELECT event_id, meter_id, channel_id, read_dtm, 'hilo: second note. Accepted' AS comments FROM ev WHERE event_id % 11 = 0),
registerreadcomments AS (SELECT meter_id, channel_id, read_dtm, comments FROM comment_rows WHERE event_id % 10 <> 9),
registerreadcomments_deleted AS (SELECT meter_id, channel_id, read_dtm, comments FROM comment_rows WHERE event_id % 10 = 9),
switch_day AS (
  SELECT meter_id, MIN(CASE WHEN event_id % 5 = 2 THEN read_dtm END) AS edge FROM ev GROUP BY meter_id),
meter_location_xref AS (
  SELECT meter_id, meter_id AS location_no, TIMESTAMP '2023-12-01 00:00:00' AS active_dt, edge AS inactive_dt FROM switch_day
  UNION ALL
  SELECT meter_id, meter_id + 1 AS location_no, edge AS active_dt, TIMESTAMP '2024-01-29 00:00:00' AS inactive_dt FROM switch_day),
locations AS (
  SELECT c_custkey AS location_no, c_mktsegment AS location_class, c_nationkey AS billing_cycle FROM customer),
meters AS (
  SELECT DISTINCT meter_id, CASE WHEN meter_id % 4 = 0 THEN '8/9SD' WHEN meter_id % 4 = 1 THEN '2SD' WHEN meter_id % 4 = 2 THEN '15/16SD' ELSE '2SE' END AS meter_tp
  FROM ev WHERE meter_id % 13 <> 12),
billing_schedule AS (
  SELECT n_nationkey AS billing_cycle, DATE '2024-01-01' + 7 * k AS period_start_dt,
         DATE '2024-01-01' + (7 * k + CASE WHEN n_nationkey % 3 = 0 THEN 5 ELSE 7 END) AS period_end_dt,
         DATE '2024-01-01' + (7 * k + 10) AS bill_dt
  FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p)
"""

_FAILED_KEYS = f"""
failed_keys AS (
  SELECT DISTINCT meter_id, channel_id, read_dtm FROM (
    SELECT meter_id, channel_id, read_dtm FROM registerreads_history
    WHERE read_version = 1 AND status = 2 AND read_dtm >= {SINCE}
    UNION ALL
    SELECT meter_id, channel_id, read_dtm FROM registerreads WHERE status = 2 AND read_dtm >= {SINCE}) k),
current_reads AS (
  SELECT meter_id, channel_id, read_dtm, x.status, x.read_version, x.read_value, n.comments
  FROM failed_keys
  JOIN registerreads x USING (meter_id, channel_id, read_dtm)
  JOIN registerreadcomments n USING (meter_id, channel_id, read_dtm)
  WHERE NOT contains(n.comments, 'Automatically'))
"""

PROBES = {
    "accepted": _FAILED_KEYS + """,
accepted AS (SELECT meter_id, channel_id, read_dtm, read_value, comments, 1 AS label
             FROM current_reads WHERE status = 5 AND contains(comments, 'Accepted'))""",
    "failed": _FAILED_KEYS + """,
failed AS (SELECT meter_id, channel_id, read_dtm, read_value, comments, 0 AS label FROM current_reads WHERE status = 2)""",
    "deleted": f"""
deleted AS (SELECT meter_id, channel_id, read_dtm, d.read_value, n.comments, 0 AS label
            FROM registerreads_deleted d JOIN registerreadcomments_deleted n USING (meter_id, channel_id, read_dtm)
            WHERE d.status = 2 AND read_dtm >= {SINCE})""",
}
PROBES["labelled"] = (
    PROBES["accepted"]
    + ","
    + PROBES["failed"].removeprefix(_FAILED_KEYS).lstrip(",")
    + ","
    + PROBES["deleted"]
    + """,
labelled AS (SELECT * FROM accepted UNION ALL SELECT * FROM failed UNION ALL SELECT * FROM deleted)"""
)


def lookup(probe: str, aggregate: str, test: str, instant: str, name: str) -> str:
    """Literal nearest-instant lookup, one aggregate per probe row."""
    return (
        f"LEFT JOIN LATERAL (SELECT {aggregate}(b.read_dtm) AS {name} FROM registerreads b "
        f"WHERE b.meter_id = {probe}.meter_id AND b.channel_id = {probe}.channel_id "
        f"AND b.read_dtm {test} {instant}) at_{name} ON TRUE"
    )


def _calendar(prefix: str, ts: str) -> str:
    return (
        f"CAST(year({ts}) AS INT) AS {prefix}YEAR, CAST(month({ts}) AS INT) AS {prefix}MONTH, "
        f"CAST(day({ts}) AS INT) AS {prefix}DAY, upper(strftime({ts}, '%a')) AS {prefix}DOW"
    )


_FLAGS = ", ".join(
    f"CASE WHEN strpos(p.comments, '{mark}') > 0 THEN 1 ELSE 0 END AS {name}"
    for name, mark in (
        ("HILO", "HiLo:"),
        ("REGISTERINCREASING", "RegisterIncreasing:"),
        ("SUMCHECK", "SumCheck:"),
        ("MAXDAILYUSAGE", "MaxDailyUsage:"),
    )
)


def context_ctes(probe: str, version: int = 2) -> str:
    """CTE text ending in ``wide``: the context of every row of ``probe``."""
    second = version == 2
    same = "{0}.meter_id = p.meter_id AND {0}.channel_id = p.channel_id AND {0}.read_dtm = "
    return f"""
anchored AS (
  SELECT p.*, prev_dtm, prev2_dtm, next_dtm FROM {probe} p
  {lookup("p", "max", "<", "p.read_dtm", "prev_dtm")}
  {lookup("p", "max", "<", "prev_dtm", "prev2_dtm")}
  {lookup("p", "min", ">", "p.read_dtm", "next_dtm")}),
wide AS (
  SELECT p.read_dtm AS READ_DTM, p.channel_id AS CHANNEL_ID, p.label,
    p.meter_id AS METER_ID, place.location_no AS LOCATION_NO, place.location_class AS LOCATION_CLASS,
    place.billing_cycle AS BILLING_CYCLE, {_calendar("", "p.read_dtm")}, p.comments AS COMMENTS,
    p.read_value AS READ_VALUE, a.read_value AS PREV_READ, b.read_value AS PREV_READ2,
    {_calendar("PREV", "p.prev_dtm")}, {"a.uom AS PREV_UOM," if second else ""}
    {_calendar("PREVPREV", "p.prev2_dtm")}, {"b.uom AS PREVPREV_UOM," if second else ""}
    a.uom AS UOM, a.status AS PREV_STATUS, b.status AS PREV_STATUS2,
    {_calendar("NEXT", "p.next_dtm") + ", c.uom AS NEXT_UOM, c.status AS NEXT_STATUS, c.read_value AS NEXT_READ_VALUE," if second else ""}
    CAST(round((SELECT epoch_us(CAST(min(s.bill_dt) AS TIMESTAMP)) - epoch_us(p.read_dtm) FROM billing_schedule s
     WHERE s.billing_cycle = place.billing_cycle
       AND CAST(p.read_dtm AS DATE) BETWEEN s.period_start_dt AND s.period_end_dt) / 86400000000.0) AS DOUBLE) AS DAYS_FROM_BILLDT,
    {_FLAGS}{''', kind.meter_tp AS METER_TP, CAST(strftime(p.read_dtm, '%I') AS INT) AS READ_HR,
    CAST(minute(p.read_dtm) AS INT) AS READ_MIN, CAST(second(p.read_dtm) AS INT) AS READ_SECOND''' if second else ""}
  FROM anchored p
  JOIN registerreads a ON {same.format("a")} p.prev_dtm
  JOIN registerreads b ON {same.format("b")} p.prev2_dtm
  {"JOIN registerreads c ON " + same.format("c") + " p.next_dtm JOIN meters kind ON kind.meter_id = p.meter_id" if second else ""}
  JOIN meter_location_xref x ON x.meter_id = p.meter_id AND p.read_dtm >= x.active_dt AND p.read_dtm < x.inactive_dt
  JOIN locations place ON place.location_no = x.location_no)
"""


def warehouse_query(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([WAREHOUSE, *ctes]) + select


def extraction(probe: str, version: int = 2, select: str | None = None) -> str:
    from readsift.schemas import exception_columns

    columns = ", ".join(exception_columns(version))
    return warehouse_query(
        select or f"SELECT {columns} FROM wide", PROBES[probe], context_ctes(probe, version)
    )
