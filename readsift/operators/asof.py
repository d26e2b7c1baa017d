"""Strict as-of neighbours on a sliced timeline.

For each probe instant the operator finds the last and second-last distinct base
instant before it and the first one after it, per key. A key's timeline is cut
into slices of calendar time, so no key, however long its history, has to fit in
one task:

1. all rows are partitioned once, by key and slice; collapsing the copies of an
   instant, the window inside a slice and the slice summaries all use that one
   exchange, and a hot key still spreads over as many tasks as it has slices;
2. inside a slice, ``lag``/``lead`` over distinct instants answer most probes;
3. each slice is summarised in one row (first, last, second-last instant), the
   summaries are carried over slice borders, and join back to the probes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from readsift.functions.calendar import day_of

_BASE, _PROBE = 1, 2


def _over(function: str, by: Sequence[str], on: str) -> Column:
    keys = ", ".join(f"`{c}`" for c in by)
    return F.expr(f"{function} IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY `{on}`)")


def neighbour_instants(
    probes: DataFrame,
    base: DataFrame,
    by: Sequence[str],
    on: str,
    slice_of: Callable[[Column], Column] = day_of,
) -> DataFrame:
    """Distinct probe keys with ``prev_<on>``, ``prev2_<on>`` and ``next_<on>``.

    ``slice_of`` must be monotone in ``on``. Missing neighbours are NULL; a probe
    with a NULL key has none and is left out.
    """
    keys = [*by, on]
    # Both branches below read the same columns of the sliced timeline and, with
    # the NULL tests stated here, push the same filters down: they share its exchange.
    sliced = [*by, "_slice"]
    timeline = (
        base.select(*keys, F.lit(_BASE).alias("_role"))
        .unionByName(probes.select(*keys, F.lit(_PROBE).alias("_role")))
        .withColumn("_slice", slice_of(F.col(on)))
        .where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, "_slice")]))
        .repartition(*sliced)
        .groupBy(*sliced, on)
        .agg(F.bit_or("_role").alias("_role"))
        .withColumn("_at", F.when(F.col("_role").bitwiseAND(_BASE) > 0, F.col(on)))
    )
    located = timeline.select(
        "*",
        _over("lag(_at, 1)", sliced, on).alias("_prev"),
        _over("lag(_at, 2)", sliced, on).alias("_prev2"),
        _over("lead(_at, 1)", sliced, on).alias("_next"),
    )

    summary = located.groupBy(*sliced).agg(
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
        F.max_by("_prev", "_at").alias("_second_last"),
        F.bit_or("_role").alias("_roles"),
    )
    carried = (
        summary.withColumn("_c_prev", _over("lag(_last, 1)", by, "_slice"))
        .withColumn("_c_next", _over("lead(_first, 1)", by, "_slice"))
        .withColumn(
            "_second_so_far",
            F.when(F.col("_last").isNotNull(), F.coalesce("_second_last", "_c_prev")),
        )
        .withColumn("_c_prev2", _over("lag(_second_so_far, 1)", by, "_slice"))
        .where(F.col("_roles").bitwiseAND(_PROBE) > 0)
        .select(*sliced, "_c_prev", "_c_prev2", "_c_next")
    )

    return (
        located.where(F.col("_role").bitwiseAND(_PROBE) > 0)
        .join(carried, sliced)
        .select(
            *keys,
            F.coalesce("_prev", "_c_prev").alias(f"prev_{on}"),
            F.when(F.col("_prev").isNull(), F.col("_c_prev2"))
            .otherwise(F.coalesce("_prev2", "_c_prev"))
            .alias(f"prev2_{on}"),
            F.coalesce("_next", "_c_next").alias(f"next_{on}"),
        )
    )


def _one_neighbour(which: str, probes, base, by, on, slice_of) -> DataFrame:
    """Probes that have the wanted neighbour, joined to every base row at it."""
    target = f"{which}_{on}"
    found = (
        neighbour_instants(probes, base, by, on, slice_of)
        .select(*by, on, target)
        .where(F.col(target).isNotNull())
    )
    payload = [c for c in base.columns if c not in (*by, on)]
    matched = base.select(*by, F.col(on).alias(target), *[F.col(c).alias(f"{which}_{c}") for c in payload])
    return probes.join(found, [*by, on]).join(matched, [*by, target])


def asof_backward(probes, base, by, on, slice_of=day_of) -> DataFrame:
    """Base rows at the last instant strictly before each probe."""
    return _one_neighbour("prev", probes, base, by, on, slice_of)


def asof_second_backward(probes, base, by, on, slice_of=day_of) -> DataFrame:
    """Base rows at the second-last distinct instant before each probe."""
    return _one_neighbour("prev2", probes, base, by, on, slice_of)


def asof_forward(probes, base, by, on, slice_of=day_of) -> DataFrame:
    """Base rows at the first instant strictly after each probe."""
    return _one_neighbour("next", probes, base, by, on, slice_of)
