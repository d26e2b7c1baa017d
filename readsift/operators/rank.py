"""Global positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from readsift.session import stage

# monotonically_increasing_id() keeps the partition number above bit 33 and the
# position inside the partition below it.
_POSITION_BITS = 33
#: Starts of slices that go to every task, some 40 bytes each.
SENT_STARTS = 500_000


def spread_sort(df: DataFrame, *order_by: str, from_scan: bool = False) -> DataFrame:
    """Global sort in which equal keys may fall into several tasks.

    A range sort sends equal keys to one task; the number added here as last key
    lets it cut a mass of ties anywhere. That number must come out the same when a
    lost task runs again, so ``df`` is staged first; ``from_scan`` says that it only
    filters and projects stored files, whose row order is fixed already.
    """
    fixed = df if from_scan else stage(df, "sort-input")
    return fixed.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order_by, "_tie").drop("_tie")


def row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_idx", from_scan: bool = False
) -> DataFrame:
    """Add the position 0..n-1 of each row in the order of ``order_by``.

    Rows equal in ``order_by`` are ordered by the remaining columns; which of two
    exact copies is first cannot be seen in the result. The sorted frame is staged:
    positions stay fixed across later actions. ``from_scan`` as in
    :func:`spread_sort`.
    """
    rest = [c for c in df.columns if c not in order_by]
    ordered = spread_sort(df, *order_by, *rest, from_scan=from_scan).withColumn("_pos", F.monotonically_increasing_id())
    staged = stage(ordered, "row-index").withColumn("_part", F.shiftright("_pos", _POSITION_BITS))
    # One row per Spark partition: the only input of the unpartitioned window.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        staged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    within = F.col("_pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        staged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_start", "_pos")
    )


def seeded_key(seed: int, key: Column | str) -> Column:
    """Reproducible shuffle key: hex digest of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seeded_rank(
    df: DataFrame,
    key: str,
    seed: int,
    within: Sequence[str] = (),
    name: str = "rank",
    hex_digits: int = 4,
) -> DataFrame:
    """Rank rows 0.. in a seeded random order, per group of ``within``.

    ``key`` must be unique. Digests are uniform, so their first hex digits cut
    every group, also one that holds most rows, into 16**hex_digits even slices;
    slice counts (at most that many rows per group) give each slice its start.
    """
    groups = list(within)
    # The digest's bytes have the order of its text at half the size, and cost less to make than numbers.
    digest, slice_bytes = F.unhex(seeded_key(seed, key)), max(-(-hex_digits // 2), 1)
    keyed = df.withColumns({"_slice": F.substring(digest, 1, slice_bytes), "_rest": F.substring(digest, slice_bytes + 1, 16)})
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        keyed.groupBy(*groups, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
        .withColumnsRenamed({g: f"_g_{g}" for g in groups})
        .withColumnRenamed("_slice", "_s_slice"),
        "slice-starts",
    )
    same_slice = F.col("_slice") == F.col("_s_slice")
    for g in groups:
        same_slice = same_slice & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    # The slice is the first thing to sort by: the few groups tell hardly any rows apart.
    in_slice = Window.partitionBy("_slice", *groups).orderBy("_rest", key)
    return (
        keyed.withColumn("_in_slice", F.row_number().over(in_slice) - 1)
        # Sent to the tasks, or the rows would be shuffled once more; of many groups they are too many for that.
        .join(F.broadcast(starts) if starts.count() <= SENT_STARTS else starts, same_slice)
        .withColumn(name, (F.col("_start") + F.col("_in_slice")).cast("bigint"))
        .drop("_slice", "_s_slice", "_rest", "_start", "_in_slice", *[f"_g_{g}" for g in groups])
    )


def seeded_ranks(df: DataFrame, key: str, seed: int, members: Sequence[Column], name: str, slice_bytes: int = 2) -> DataFrame:
    """For each condition of ``members`` the :func:`seeded_rank` of a row among those that meet it, null for other rows: an
    array, from one shuffle. All rows stay; one with a null key has no ranks."""
    digest = F.unhex(seeded_key(seed, key))
    marked = df.withColumns({
        "_slice": F.substring(digest, 1, slice_bytes), "_rest": F.substring(digest, slice_bytes + 1, 16),
        "_in": F.array(*[F.coalesce(m, F.lit(False)) for m in members]),
    })
    each = range(len(members))
    met = [F.when(F.get("_in", F.lit(i)), 1).otherwise(0) for i in each]
    earlier = Window.partitionBy().orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.where("_slice IS NOT NULL").groupBy("_slice").agg(*[F.sum(m).alias(f"_{i}") for i, m in enumerate(met)])
    # At most 256 ** slice_bytes rows.
    before = F.array(*[F.coalesce(F.sum(f"_{i}").over(earlier), F.lit(0)) for i in each])
    starts = stage(counted.select(F.col("_slice").alias("_s_slice"), before.alias("_start")), "slice-starts")
    so_far = Window.partitionBy("_slice").orderBy("_rest", key).rowsBetween(Window.unboundedPreceding, 0)
    counts = F.array(*[F.sum(m).over(so_far) for m in met])
    rank = lambda start, i: F.when(F.get("_in", i), start + F.get("_count", i) - 1)
    return (
        marked.withColumn("_count", counts).join(F.broadcast(starts), F.col("_slice") == F.col("_s_slice"), "left")
        .withColumn(name, F.transform("_start", rank)).drop("_slice", "_s_slice", "_rest", "_in", "_count", "_start")
    )
