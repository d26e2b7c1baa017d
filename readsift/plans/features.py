"""Feature builders: from an extracted exception to a learnable frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readsift import config
from readsift.operators.rank import spread_sort

# Identifiers that never reach a learner.
IDENTIFIERS = ("METER_ID", "LOCATION_NO", "BILLING_CYCLE", "COMMENTS", "DAYS_FROM_BILLDT")
IDENTIFIERS_HASHED_LOCATION = ("METER_ID", "LOCATION_HASH", "BILLING_CYCLE", "COMMENTS", "DAYS_FROM_BILLDT")


def require(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the frame: {missing}")


def without(df: DataFrame, columns) -> DataFrame:
    """Drop columns, all of which must exist."""
    require(df, columns)
    return df.drop(*columns)


def read_time_features(df: DataFrame) -> DataFrame:
    """Day and month of the read in place of its time stamp and meter."""
    require(df, ("READ_DTM", "METER_ID"))
    ts = F.col("READ_DTM")
    return df.withColumns({"DAY": F.dayofmonth(ts), "MONTH": F.month(ts)}).drop("READ_DTM", "METER_ID")


def exception_features(df: DataFrame) -> DataFrame:
    return without(df, IDENTIFIERS)


def hashed_location_features(df: DataFrame) -> DataFrame:
    return without(df, IDENTIFIERS_HASHED_LOCATION)


def time_series_features(df: DataFrame, tie_break: tuple[str, ...] = (), sort: bool = True) -> DataFrame:
    """Exception features plus the ``Date`` they are ordered by.

    A day holds many reads, so ``tie_break`` columns make the order reproducible.
    A bad date raises under ANSI mode.
    """
    made = without(df, IDENTIFIERS).withColumn(config.DATE_COLUMN, F.make_date("YEAR", "MONTH", "DAY"))
    return spread_sort(made, config.DATE_COLUMN, *tie_break) if sort else made


def checked(df: DataFrame, schema) -> DataFrame:
    """Pass a raw frame on unchanged once it holds the declared columns and types."""
    require(df, schema.fieldNames())
    wrong = [
        (f.name, df.schema[f.name].dataType.simpleString(), f.dataType.simpleString())
        for f in schema
        if df.schema[f.name].dataType != f.dataType
    ]
    if wrong:
        raise TypeError(f"column types differ (name, found, declared): {wrong}")
    return df


def split_label(df: DataFrame, label: str = config.TARGET_COLUMN) -> tuple[DataFrame, DataFrame]:
    """Features and label as two projections of one frame."""
    require(df, (label,))
    return df.drop(label), df.select(label)


def align_to(df: DataFrame, columns) -> DataFrame:
    """Keep, in training order, the columns a trained model knows."""
    require(df, columns)
    return df.select(*columns)


def as_doubles(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
