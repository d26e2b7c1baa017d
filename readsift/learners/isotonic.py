"""Isotonic regression of a label on a score, fitted and applied without a single-task pass over the scores.

Distinct scores are range-partitioned and each part pools its own adjacent violators into blocks of rising means. A
block is settled when no earlier part ends above its mean and no later part starts below it: whatever else is pooled
stays on its own side. The other blocks go on in pairs of neighbouring parts until all are settled. Sums are whole
numbers, so the blocks are those of one pass over all scores, however the parts fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from readsift.session import stage

#: Points that a task holds to answer by; more are joined.
HELD_POINTS = 20_000
_BLOCKS = "part int, lo double, hi double, n bigint, ones bigint"


def pool(blocks: Iterator[tuple]) -> list[list]:
    """Blocks [lo, hi, n, ones] of strictly rising means from blocks in the order of their scores."""
    made: list[list] = []
    for lo, hi, n, ones in blocks:
        made.append([lo, hi, int(n), int(ones)])
        while len(made) > 1 and made[-2][3] * made[-1][2] >= made[-1][3] * made[-2][2]:
            _, hi, n, ones = made.pop()
            last = made[-1]
            last[1], last[2], last[3] = hi, last[2] + n, last[3] + ones
    return made


def _pooled_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of one sorted part, read batch by batch."""
    part, kept = None, []
    for pdf in batches:
        if len(pdf):
            part = int(pdf["part"].iloc[0])
            rows = zip(pdf["score"], pdf["score"], pdf["n"], pdf["ones"])
            kept = pool((*map(tuple, kept), *rows))
    if kept:
        yield pd.DataFrame(kept, columns=["lo", "hi", "n", "ones"]).assign(part=part)[["part", "lo", "hi", "n", "ones"]]


def _pooled_pairs(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    rows = blocks.sort_values("lo")[["lo", "hi", "n", "ones"]].itertuples(index=False, name=None)
    return pd.DataFrame(pool(rows), columns=["lo", "hi", "n", "ones"]).assign(part=key[0])[["part", "lo", "hi", "n", "ones"]]


def isotonic_blocks(scored: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, lo, hi, n, ones), staged: blocks of scores of (score, label) with the same fitted value ones / n.

    Means rise strictly from block to block. Rows without a score or label say nothing; without rows no blocks.
    """
    spark = scored.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = scored.where("score IS NOT NULL AND label IS NOT NULL").groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("ones")
    )
    # Staged, so that a part keeps its number; a file is never larger than what its task sorted.
    ordered = distinct.repartitionByRange(parts, "score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id())
    blocks = stage(ordered.select("part", "score", "n", "ones").mapInPandas(_pooled_parts, _BLOCKS), "isotonic")
    while True:
        mean = F.col("ones") / F.col("n")
        ends = blocks.groupBy("part").agg(F.min(mean).alias("first"), F.max(mean).alias("last"))
        # One row per part.
        along = Window.orderBy("part")
        limits = ends.select(
            "part", F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("floor"),
            F.min("first").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("ceiling"),
        )
        judged = blocks.join(F.broadcast(limits), "part")
        # Equal means belong to one block, so a block that meets a limit isn't settled either.
        loose = F.coalesce(mean <= F.col("floor"), F.lit(False)) | F.coalesce(mean >= F.col("ceiling"), F.lit(False))
        judged = judged.select("part", "lo", "hi", "n", "ones", loose.alias("loose"))
        if judged.where("loose").isEmpty():
            return blocks
        pair = judged.withColumn("part", F.floor(F.col("part") / 2).cast("int"))
        moved = pair.where("loose").drop("loose").groupBy("part").applyInPandas(_pooled_pairs, _BLOCKS)
        blocks = stage(pair.where("NOT loose").drop("loose").unionByName(moved), "isotonic")


@dataclass(frozen=True)
class IsotonicSteps:
    """Fitted blocks. Between blocks the value is interpolated, outside all of them it is the nearest one's."""

    points: DataFrame
    held_points: int = HELD_POINTS

    @classmethod
    def of(cls, blocks: DataFrame) -> "IsotonicSteps":
        ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
        return cls(stage(blocks.select(ends, (F.col("ones") / F.col("n")).alias("y")), "isotonic-points"))

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_cal``, the fitted value of ``score``; null for a null score, or without blocks."""
        count = self.points.count()
        if count == 0:
            return df.withColumn("_cal", F.lit(None).cast("double"))
        if count <= self.held_points:
            held = self.points.orderBy("x").toPandas()
            x, y = held["x"].to_numpy(), held["y"].to_numpy()

            @F.pandas_udf("double")
            def looked_up(score: pd.Series) -> pd.Series:
                found = np.interp(score.to_numpy(float), x, y)
                return pd.Series(found).where(score.notna().to_numpy())

            return df.withColumn("_cal", looked_up("score"))
        return self._joined(df)

    def _joined(self, df: DataFrame, slices: int = 256) -> DataFrame:
        """By a join: every distinct score meets the points below and above it in its slice of the range, or the ends of
        the slices beside."""
        cuts = self.points.select(F.percentile_approx("x", [i / slices for i in range(1, slices)], 10_000)).first()[0]
        slice_of = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("x")))
        point = F.struct("x", "y")
        both = self.points.select("x", "y").unionByName(
            df.where("score IS NOT NULL").select(F.col("score").alias("x"), F.lit(None).cast("double").alias("y")).distinct()
        ).withColumn("slice", slice_of).withColumn("point", F.when(F.col("y").isNotNull(), point))
        ends = both.groupBy("slice").agg(F.max("point").alias("top"), F.min("point").alias("bottom"))
        along = Window.orderBy("slice")
        beside = ends.select(
            "slice", F.last("top", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("below_all"),
            F.first("bottom", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("above_all"),
        )
        own = Window.partitionBy("slice").orderBy("x")
        # A range frame takes in a point at the score itself.
        met = both.withColumns({
            "below": F.last("point", True).over(own.rangeBetween(Window.unboundedPreceding, 0)),
            "above": F.first("point", True).over(own.rangeBetween(0, Window.unboundedFollowing)),
        }).where("y IS NULL").join(F.broadcast(beside), "slice")
        below, above = F.coalesce("below", "below_all"), F.coalesce("above", "above_all")
        answers = met.select(F.col("x").alias("_x"), _between(F.col("x"), below, above).alias("_cal"))
        return df.join(answers, F.col("score") == F.col("_x"), "left").drop("_x")


def _between(x: Column, below: Column, above: Column) -> Column:
    """Linear between two points; the only one where the other is missing."""
    slope = (above["y"] - below["y"]) / (above["x"] - below["x"])
    inner = F.when(above["x"] == below["x"], below["y"]).otherwise(slope * (x - below["x"]) + below["y"])
    return F.when(below.isNull(), above["y"]).when(above.isNull(), below["y"]).otherwise(inner)
