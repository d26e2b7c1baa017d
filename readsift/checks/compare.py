"""Run registered queries beside their oracle text and compare the results."""

from __future__ import annotations

import math
import time
from collections import Counter

_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, function, sql):
    """Return (ok, message, seconds of the Spark side)."""
    began = time.time()
    df = function(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"rows only: {len(rows)}", took
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    expected = relation.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}", took
    kinds = {d[0]: str(d[1]) for d in relation.description}
    ours, theirs = _bag(df.columns, rows), _bag(names, expected)
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        return False, (
            f"rows {len(rows)} against {len(expected)}; only here {list(extra)[:2]}; only there {list(missing)[:2]}"
        ), took
    spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return True, f"{len(rows)} rows; " + ", ".join(
        f"{c}:{spark_kinds[c]}/{kinds[c]}" for c in df.columns if _loose(spark_kinds[c], kinds[c])
    ), took


# Spark type and the oracle type that stores the same values.
_SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


def _loose(spark_kind: str, duck_kind: str) -> bool:
    return _SAME.get(spark_kind, duck_kind) != duck_kind
