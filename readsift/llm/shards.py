"""Sharding by a Feistel permutation of global row numbers.

A row's place in the shuffle is a formula of (its number, the number of rows, the seed): any task
can compute the shard and slot of any row (:func:`permute`), and the row behind any slot
(:func:`unpermute`), without moving rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from readsift.operators.rank import row_index

ROUNDS = 6
WALKS = 24
_PRIME = (1 << 31) - 1  # products of two residues stay below 2**62


def _round_keys(seed: int) -> list[tuple[int, int]]:
    keys, state = [], (seed * 1_103_515_245 + 12_345) % _PRIME
    for _ in range(ROUNDS):
        first = state = (state * 48_271 + 11) % _PRIME
        state = (state * 48_271 + 11) % _PRIME
        keys.append((first or 1, state))
    return keys


def sides(n_rows: int) -> tuple[int, int]:
    """Radices (left, right) of the network: left * right >= n_rows, with fewer than left numbers
    too many."""
    left = max(1, math.isqrt(max(n_rows - 1, 0)) + 1)
    return left, max(1, -(-n_rows // left))


def _div(x: Column, by: int) -> Column:
    return ((x - x % by) / by).cast("bigint")  # exact below 2**53


def _scramble(half: Column, a: Column, b: Column) -> Column:
    linear = (half % _PRIME * a + b) % _PRIME
    return (linear * linear % _PRIME * linear + b) % _PRIME


def _network(x: Column, n_rows: int, seed: int, backwards: bool) -> Column:
    left, right = sides(n_rows)
    keys = list(enumerate(_round_keys(seed)))
    long = lambda v: F.lit(v).cast("bigint")
    rounds = F.array(*[
        F.struct(F.lit(i % 2 == 0).alias("on_left"), long(a).alias("a"), long(b).alias("b"))
        for i, (a, b) in (reversed(keys) if backwards else keys)
    ])
    sign = -1 if backwards else 1

    def step(state: Column, key: Column) -> Column:
        from_right = F.pmod(state["l"] + sign * _scramble(state["r"], key["a"], key["b"]), long(left))
        from_left = F.pmod(state["r"] + sign * _scramble(state["l"], key["a"], key["b"]), long(right))
        return F.struct(
            F.when(key["on_left"], from_right).otherwise(state["l"]).alias("l"),
            F.when(key["on_left"], state["r"]).otherwise(from_left).alias("r"),
        )

    start = F.struct(_div(x, right).alias("l"), (x % right).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * right + s["r"])


def _walk(x: Column, n_rows: int, seed: int, backwards: bool) -> Column:
    """Cycle walking: apply the network until the number is below ``n_rows``.

    Fewer than sqrt(n) + 1 numbers lie outside. Up to 576 rows ``WALKS`` steps are as many as there
    can be; beyond, a row needs more with a chance below 1e-33, and the job would then
    fail rather than give a wrong place.
    """
    first = _network(x, n_rows, seed, backwards)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        first,
        lambda at, _: F.when(at < n_rows, at).otherwise(_network(at, n_rows, seed, backwards)),
    )
    return F.when(walked < n_rows, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def permute(number: Column, n_rows: int, seed: int = 0) -> Column:
    """Place 0..n_rows-1 of a row number in the seeded shuffle (a bijection)."""
    return _walk(number, n_rows, seed, backwards=False)


def unpermute(place: Column, n_rows: int, seed: int = 0) -> Column:
    """The row number at a place: the inverse of :func:`permute`."""
    return _walk(place, n_rows, seed, backwards=True)


def shard_rows(df: DataFrame, order_by: Sequence[str], n_shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number`` (in the order of ``order_by``, then of the other columns), ``shard``
    and ``slot``: shards differ by one row at most, and slots count from 0 without a gap.

    The place p of a row in the shuffle gives shard p mod n and slot p div n. Numbering ranges over
    sorted partitions, with ties cut anywhere, so no key can fill a task; the sorted rows are
    staged, so places hold when a task runs again. Nulls sort first and count as rows; rows that are
    equal throughout take neighbouring numbers, whichever is first; an empty table gives no rows.
    Columns named like the three new ones are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    clean = df.drop("row_number", "shard", "slot")
    numbered = row_index(clean, order_by, "row_number")
    n_rows = numbered.count()
    place = permute(F.col("row_number"), n_rows, seed)
    return (
        numbered.withColumn("_place", place)
        .withColumn("shard", (F.col("_place") % n_shards).cast("int"))
        .withColumn("slot", _div(F.col("_place"), n_shards))
        .drop("_place")
    )


def write_shards(sharded: DataFrame, path: str, slots_per_file: int = 1_000_000) -> None:
    """One folder per shard, its rows sorted by slot. Large shards are cut into files of
    ``slots_per_file`` slots, each the work of one task."""
    spread = sharded.withColumn("_file", _div(F.col("slot"), slots_per_file))
    (
        spread.repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot").drop("_file")
        .write.partitionBy("shard").parquet(path)
    )

