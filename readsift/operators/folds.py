"""Hold-outs and cross-validation folds as columns and predicates.

A fold is two predicates on one indexed frame, never a copy of it. Ordered
schemes read the position column of :func:`readsift.operators.rank.row_index`;
shuffled schemes add one fold column made from a seeded rank.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from readsift.config import Experiment
from readsift.operators.rank import seeded_rank
from readsift.session import stage

INDEX = "row_idx"


@dataclass(frozen=True)
class Fold:
    number: int
    train: Column
    test: Column


def _between(index: str, start: int, stop: int) -> Column:
    return (F.col(index) >= start) & (F.col(index) < stop)


def ordered_train_size(n: int, share: float) -> int:
    return floor(share * n)


def ordered_holdout(df: DataFrame, n: int, share: float, index: str = INDEX) -> DataFrame:
    """Mark the first ``share`` of positions ``train``, the rest ``test``."""
    size = ordered_train_size(n, share)
    return df.withColumn("role", F.when(F.col(index) < size, "train").otherwise("test"))


def class_quotas(counts: dict, size: int) -> dict:
    """Split ``size`` over classes by their counts, largest remainder first."""
    n = sum(counts.values())
    quota = {c: size * k // n for c, k in counts.items()}
    by_remainder = sorted(counts, key=lambda c: (-(size * counts[c] % n), str(c)))
    for c in by_remainder[: size - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_holdout(
    df: DataFrame, label: str, share: float, seed: int, key: str = INDEX
) -> DataFrame:
    """Seeded shuffle per class; each class gives its quota to ``train``."""
    counts = {row[label]: row["n"] for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = class_quotas(counts, ordered_train_size(sum(counts.values()), share))
    limit = F.lit(None).cast("bigint")
    for value, size in quota.items():
        limit = F.when(F.col(label).eqNullSafe(F.lit(value)), size).otherwise(limit)
    ranked = seeded_rank(df, key, seed, [label], "_rank")
    return ranked.withColumn("role", F.when(F.col("_rank") < limit, "train").otherwise("test")).drop("_rank")


def sliding_folds(n: int, folds: int, share: float, index: str = INDEX) -> list[Fold]:
    """Consecutive equal windows, each cut into a leading train and a trailing test
    part. Positions past ``folds`` whole windows belong to no fold."""
    if folds + 1 > n:
        raise ValueError(f"{folds} folds need more than {folds} rows, got {n}")
    width = n // folds
    lead = int(share * width)
    return [
        Fold(i, _between(index, i * width, i * width + lead), _between(index, i * width + lead, (i + 1) * width))
        for i in range(folds)
    ]


def expanding_bounds(n: int, folds: int) -> list[tuple[int, int, int]]:
    """(fold, stop, end): fold trains on the rows before ``stop`` and tests on those from there to ``end``."""
    if folds + 1 > n:
        raise ValueError(f"{folds} folds need more than {folds} rows, got {n}")
    width = n // (folds + 1)
    return [(i, n - (folds - i) * width, n - (folds - i - 1) * width) for i in range(folds)]


def expanding_folds(n: int, folds: int, index: str = INDEX) -> list[Fold]:
    """Equal test windows at the end; each trains on everything before it."""
    return [Fold(i, F.col(index) < stop, _between(index, stop, end)) for i, stop, end in expanding_bounds(n, folds)]


def stratified_fold_column(
    df: DataFrame, label: str, folds: int, seed: int, key: str = INDEX, name: str = "fold"
) -> DataFrame:
    """Deal each class, in seeded random order, round the folds."""
    return seeded_rank(df, key, seed, [label], "_rank").withColumn(
        name, (F.col("_rank") % folds).cast("int")
    ).drop("_rank")


def folds_of_column(folds: int, name: str = "fold", first_number: int = 0) -> list[Fold]:
    return [Fold(first_number + i, F.col(name) != i, F.col(name) == i) for i in range(folds)]


def repeated_stratified(
    df: DataFrame, label: str, folds: int, repeats: int, seed: int, key: str = INDEX
) -> tuple[DataFrame, list[Fold]]:
    """``repeats`` independent stratified deals, one fold column each.

    The deals are made on key and label alone and join the frame once. Each is staged: a deal
    reads its input twice, which would double with every repeat.
    """
    deals, made = stage(df.select(key, label), "deals"), []
    for r in range(repeats):
        deals = stage(stratified_fold_column(deals, label, folds, seed + r, key, f"fold_{r}"), "deals")
        made += folds_of_column(folds, f"fold_{r}", r * folds)
    return df.join(deals.drop(label), key), made


def fold_scheme(
    df: DataFrame, n: int, experiment: Experiment, label: str, index: str = INDEX
) -> tuple[DataFrame, list[Fold]]:
    """The scheme an experiment asks for: expanding or sliding for time series,
    else stratified, once or repeated."""
    if experiment.time_series:
        if experiment.expanding:
            return df, expanding_folds(n, experiment.folds, index)
        return df, sliding_folds(n, experiment.folds, experiment.train_share, index)
    if experiment.repeated:
        return repeated_stratified(df, label, experiment.folds, experiment.repeats, experiment.seed, index)
    dealt = stratified_fold_column(df, label, experiment.folds, experiment.seed, index)
    return dealt, folds_of_column(experiment.folds)


def fold_membership(df: DataFrame, folds: list[Fold], index: str = INDEX) -> DataFrame:
    """One row per (row, fold) it takes part in, with its role."""
    roles = F.array(
        *[
            F.struct(
                F.lit(f.number).alias("fold"),
                F.when(f.train, "train").when(f.test, "test").alias("role"),
            )
            for f in folds
        ]
    )
    return (
        df.select(index, F.explode(roles).alias("m"))
        .select(index, "m.fold", "m.role")
        .where(F.col("role").isNotNull())
    )


def expanding_fold_sizes(df: DataFrame, sizes: list[int], folds: int, index: str = INDEX) -> DataFrame:
    """Rows per (size, fold, role) when each prefix of size + 1 rows is cut into
    expanding folds: one pass counts rows per test window, the train part of a fold
    is the sum of the windows before its own."""
    windows = []
    for size in sizes:
        n = size + 1
        width = n // (folds + 1)
        window = F.floor((F.col(index) - (n - folds * width)) / width).cast("int")
        windows.append(
            F.when(
                F.col(index) < n,
                F.struct(F.lit(size).cast("bigint").alias("size"), F.greatest(window, F.lit(-1)).alias("fold")),
            )
        )
    counted = (
        df.select(F.explode(F.array(*windows)).alias("w"))
        .where(F.col("w").isNotNull())
        .groupBy("w.size", "w.fold")
        .agg(F.count(F.lit(1)).alias("test"))
    )
    earlier = Window.partitionBy("size").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    both = counted.withColumn("train", F.sum("test").over(earlier)).where(F.col("fold") >= 0)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("n_rows")) for r in ("train", "test")])
    return both.select("size", "fold", F.explode(roles).alias("r")).select("size", "fold", "r.*")


def permute_labels(df: DataFrame, label: str, seed: int, index: str = INDEX) -> DataFrame:
    """Give each row the label of another row, by a seeded permutation of positions."""
    donors = seeded_rank(df.select(index, label), index, seed, (), "_to").select("_to", label)
    return df.drop(label).join(donors, F.col(index) == F.col("_to")).drop("_to")


def draw_rows(df: DataFrame, n: int, draws: int, seed: int, index: str = INDEX) -> DataFrame:
    """``draws`` rows with replacement: draw i takes position hash(seed:i) mod n."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary"))
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn(
        index, F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n
    )
    # As many rows as draws were asked for.
    return df.join(F.broadcast(picks), index)
