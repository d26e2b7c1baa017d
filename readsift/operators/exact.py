"""Sums of doubles that don't depend on the order of the rows.

A double is a whole number times a power of two. Values are put into bins of 16 binary exponents; inside a bin each
is cut, without rounding, into four whole numbers of at most 18 bits, whose sums are ordinary integer sums. So
partial sums can be combined in any order and grouping, and a bin holds 2**45 rows before a sum could overflow (which
fails the job, never wraps). A group has few bins, as many as its values have magnitudes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

_BIN = 16
# Part j of a number counts units of 2 ** -_PLACES[j] of its bin.
_PLACES = (0, 18, 36, 53)
PARTS = tuple(f"part_{j}" for j in range(len(_PLACES)))
#: Values nearer to zero count as zero: scaling them up would overflow.
TINY = 2.0**-960


def parts_of(value: Column) -> Column:
    """Struct (bin, part_0..part_3) of a double; null for null, for NaN and for infinities."""
    size = F.abs(value)
    known = F.coalesce((size < float("inf")) & (size >= TINY), F.lit(False))
    number = F.when(known, F.floor(F.log2(size) / _BIN)).otherwise(F.when(size < TINY, 0)).cast("int")
    # The logarithm may round over a bin's border: a bin takes numbers from half to twice its range.
    rest = F.when(known, value * F.pow(F.lit(2.0), -_BIN * number)).otherwise(F.when(size < TINY, 0.0))
    made, before = [], 0
    for name, place in zip(PARTS, _PLACES):
        rest = rest * float(2 ** (place - before))
        whole = rest.cast("bigint")
        made.append(whole.alias(name))
        rest, before = rest - whole, place
    return F.when(number.isNotNull(), F.struct(number.alias("bin"), *made))


def _square(x: Column) -> tuple[Column, Column]:
    """x * x as a double and what it lacks, exactly (Dekker's product)."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    low = x - high
    product = x * x
    return product, ((high * high - product) + 2.0 * high * low) + low * low


def binned_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), squares: bool = True) -> DataFrame:
    """(by..., column, power, bin, part_0.., n): exact partial sums of every column and, at ``power`` 2, of its square.

    Nulls are left out. ``bin`` is null for values without a finite number. One pass, combined before the shuffle;
    sums of groups may be added part by part.
    """
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        powers = [(1, x)] + ([(2, part) for part in _square(x)] if squares else [])
        cells += [F.struct(F.lit(c).alias("column"), F.lit(p).alias("power"), v.alias("v"), x.isNotNull().alias("there")) for p, v in powers]
    long = df.select(*by, F.explode(F.array(*cells)).alias("c")).where("c.there")
    cut = long.select(*by, "c.column", "c.power", parts_of(F.col("c.v")).alias("p"))
    return cut.groupBy(*by, "column", "power", F.col("p.bin").alias("bin")).agg(
        *[F.sum(f"p.{name}").alias(name) for name in PARTS], F.count(F.lit(1)).alias("n")
    )


def exact_sum(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by..., name): sum of a double column per group, the same however the rows are spread.

    The bins of a group, a handful, are added from the smallest up. A group with a value that is not finite sums to null.
    """
    binned = binned_sums(df, [value], by, squares=False)
    fits = F.sum(F.when(F.col("bin").isNull(), 1).otherwise(0)) == 0
    total = F.lit(0.0)
    for part, place in zip(PARTS, _PLACES):
        total = total + F.col(part).cast("double") * 2.0**-place
    scaled = binned.withColumn("_size", total * F.pow(F.lit(2.0), _BIN * F.col("bin")))
    listed = F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "_size"))))
    added = F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["_size"])
    return scaled.groupBy(*by).agg(F.when(fits, added).alias(name))


@dataclass
class Total:
    """Exact count, sum and sum of squares of one column, added up from rows of :func:`binned_sums`."""

    n: int = 0
    odd: int = 0
    first: Fraction = Fraction(0)
    second: Fraction = Fraction(0)

    def add(self, row) -> None:
        if row["bin"] is None:
            self.odd += row["n"]
            return
        size = sum((Fraction(row[part], 2**place) for part, place in zip(PARTS, _PLACES)), Fraction(0))
        size *= Fraction(2) ** (_BIN * row["bin"])
        if row["power"] == 1:
            self.n += row["n"]
            self.first += size
        else:
            self.second += size

    def __add__(self, other: "Total") -> "Total":
        return Total(self.n + other.n, self.odd + other.odd, self.first + other.first, self.second + other.second)

    @property
    def mean(self) -> float | None:
        """Correctly rounded; None of no values, NaN where one is not finite (or its square is not)."""
        if self.odd:
            return math.nan
        return float(self.first / self.n) if self.n else None

    @property
    def deviation(self) -> float | None:
        """Population deviation, from the exact variance."""
        if self.odd:
            return math.nan
        return math.sqrt(max(self.second / self.n - (self.first / self.n) ** 2, 0)) if self.n else None


def totals(binned: DataFrame, columns: Sequence[str]) -> dict[str, Total]:
    """A :class:`Total` per column; a few rows a column come to the driver."""
    found = {c: Total() for c in columns}
    for row in binned.collect():
        found[row["column"]].add(row)
    return found
