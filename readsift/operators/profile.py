"""Counts, moments, vocabularies and histograms of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from readsift.operators.exact import binned_sums, totals
from readsift.operators.rank import row_index


def _unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column, all columns in one pass; NULL is not counted."""
    return (
        _unpivot(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values per column, with the slot each takes in the encoding.

    Numbers sort as numbers. ``slot`` counts through all columns, ``position``
    within one.
    """
    values = (
        _unpivot(df, columns)
        .where(F.col("value").isNotNull())
        .distinct()
        .withColumn("number", F.expr("try_cast(value AS DOUBLE)"))
    )
    slots = row_index(values, ["position", "number", "value"], "slot")
    first = slots.groupBy("column").agg(F.min("slot").alias("_first"))
    return slots.join(first, "column").select(
        "column", "value", "slot", (F.col("slot") - F.col("_first")).alias("position")
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every column, in one pass and one row each.

    Both come from exact sums, so they are the same on any partitioning, to the last bit.
    """
    found = totals(binned_sums(df, columns), columns)
    rows = [(c, t.mean, t.deviation) for c, t in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, mean double, std double")


def bin_number(x: Column, edges: Sequence[Column]) -> Column:
    """Bin of ``x`` among ``[e0, e1), ..., [ek-1, ek]``: inner edges at or below it."""
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + F.when(x >= edge, 1).otherwise(0)
    return number


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins from the least to the greatest value of each column.

    Empty bins are kept. A constant column gets one unit of width around it.
    """
    ends = df.agg(*[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]).first()
    cells = []
    for c in columns:
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        if lo is None:
            continue
        lo, hi = float(lo), float(hi)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
        cells.append((c, edges))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, n bigint")
    numbered = F.array(
        *[
            F.struct(F.lit(c).alias("column"), bin_number(F.col(c), [F.lit(e) for e in edges]).alias("bin"))
            for c, edges in cells
            ]
    )
    present = F.array(*[F.col(c).isNotNull() for c, _ in cells])
    counted = (
        df.select(F.explode(F.arrays_zip(numbered.alias("m"), present.alias("ok"))).alias("z"))
        .select(F.col("z.m.column").alias("column"), F.col("z.m.bin").alias("bin"), F.col("z.ok").alias("ok"))
        .where("ok")
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.createDataFrame(
        [(c, i, edges[i], edges[i + 1]) for c, edges in cells for i in range(bins)],
        "column string, bin int, lo double, hi double",
    )
    return frame.join(counted, ["column", "bin"], "left").fillna(0, ["n"])
