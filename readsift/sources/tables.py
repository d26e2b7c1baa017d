"""The warehouse as a set of lazily scanned relations."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from readsift.schemas import WAREHOUSE_SCHEMAS


@dataclass(frozen=True)
class Warehouse:
    registerreads: DataFrame
    registerreads_history: DataFrame
    registerreads_deleted: DataFrame
    registerreadcomments: DataFrame
    registerreadcomments_deleted: DataFrame
    meter_location_xref: DataFrame
    locations: DataFrame
    meters: DataFrame
    billing_schedule: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def from_parquet(spark: SparkSession, root: str) -> Warehouse:
    """Read every relation from ``root/<name>`` with its declared schema."""
    return Warehouse(
        **{
            name: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
            for name, schema in WAREHOUSE_SCHEMAS.items()
        }
    )


#: Tables of which only reads from the cut-off on are used; the neighbours of such a read may be older.
CUT_OFF = ("registerreads_history", "registerreads_deleted", "registerreadcomments", "registerreadcomments_deleted")


def month_starts(since: datetime, until: datetime) -> list[datetime]:
    """``since`` and the first instants of the later months before ``until``."""
    starts, year, month = [since], since.year, since.month
    while True:
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
        if datetime(year, month, 1) >= until:
            return starts
        starts.append(datetime(year, month, 1))


def read_predicates(
    name: str, meter_id_range: tuple[int, int], partitions: int, since: datetime | None = None, until: datetime | None = None
) -> list[str]:
    """Predicates of the parts in which a relation is read: disjoint, and together all rows that are wanted.

    Relations of a meter are cut into even ranges of its id, the first and last open (and nulls in the first); those of
    a read also by the month of ``read_dtm`` from ``since`` on, the last month open, where the two instants are given. Of the
    ``CUT_OFF`` tables nothing older is read; of all reads the older ones are one part per meter range. Other relations
    are one part.
    """
    columns = WAREHOUSE_SCHEMAS[name].fieldNames()
    if "meter_id" not in columns:
        return ["1 = 1"]
    low, high = meter_id_range
    cuts = sorted({low + (high - low) * i // partitions for i in range(1, partitions)})
    meters = ["1 = 1"]
    if cuts:
        inner = [f"meter_id >= {a} AND meter_id < {b}" for a, b in zip(cuts, cuts[1:])]
        meters = [f"(meter_id < {cuts[0]} OR meter_id IS NULL)", *inner, f"meter_id >= {cuts[-1]}"]
    if "read_dtm" not in columns or since is None or until is None:
        return meters
    marks = [f"TIMESTAMP '{m:%Y-%m-%d %H:%M:%S}'" for m in month_starts(since, until)]
    months = [f"read_dtm >= {a} AND read_dtm < {b}" for a, b in zip(marks, marks[1:])] + [f"read_dtm >= {marks[-1]}"]
    if name not in CUT_OFF:
        months.append(f"(read_dtm < {marks[0]} OR read_dtm IS NULL)")
    return [f"{m} AND {d}" for m in meters for d in months]


def column_types(name: str) -> str:
    """The declared schema as the database's columns are read; no cast then keeps a filter from the database."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WAREHOUSE_SCHEMAS[name])


def from_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    partitions: int,
    meter_id_range: tuple[int, int],
    since: datetime | None = None,
    until: datetime | None = None,
) -> Warehouse:
    """Read every relation over JDBC in the parts of :func:`read_predicates`, which the database filters by.

    ``meter_id_range`` and ``until`` only place borders; ids and instants outside them are still read.
    """

    def read(name: str) -> DataFrame:
        options = {"preferTimestampNTZ": "true", "customSchema": column_types(name), **properties}
        predicates = read_predicates(name, meter_id_range, partitions, since, until)
        loaded = spark.read.jdbc(url, name, predicates=predicates, properties=options)
        found = {c.lower(): c for c in loaded.columns}
        return loaded.select(*[loaded[found[f.name]].alias(f.name) for f in WAREHOUSE_SCHEMAS[name]])

    return Warehouse(**{name: read(name) for name in WAREHOUSE_SCHEMAS})


def to_parquet(warehouse: Warehouse, root: str) -> None:
    """Write every relation below ``root`` in the layout :func:`from_parquet` reads."""
    for name, df in warehouse.tables().items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")
