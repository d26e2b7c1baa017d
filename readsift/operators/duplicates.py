"""Neighbour audits and near-duplicate rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readsift.config import FeatureSpec
from readsift.operators.folds import INDEX, draw_rows
from readsift.operators.neighbours import nearest


def neighbour_audit(
    encoded: DataFrame, n: int, unknown: int, draws: int = 10, k: int = 5, seed: int = 0, index: str = INDEX
) -> DataFrame:
    """``draws`` sampled rows and the ``k`` nearest other rows of each.

    A row is told from its own copy by its id, not by being first.
    """
    ready = encoded.withColumn("id", F.col(index))
    drawn = draw_rows(ready, n, draws, seed, index)
    found = nearest(drawn.dropDuplicates(["id"]), ready, k, unknown, exclude_self=True)
    return (
        drawn.select("draw", F.col("id").alias("query_id"))
        .join(found.drop("label"), "query_id")
        .select("draw", "query_id", "neighbour_id", "rank", "distance")
    )


def audited_rows(audit: DataFrame, rows: DataFrame, index: str = INDEX) -> DataFrame:
    """The audit with the rows themselves: every column of ``rows`` as ``query_<name>`` and ``neighbour_<name>``."""
    found = audit
    for side in ("query", "neighbour"):
        own = rows.select(F.col(index).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != index])
        found = found.join(own, f"{side}_id")
    return found


def near_duplicate_rate(encoded: DataFrame, unknown: int, within: float, index: str = INDEX) -> DataFrame:
    """Rows, and those whose nearest other row is at most ``within`` away."""
    ready = encoded.withColumn("id", F.col(index))
    near = nearest(ready, ready, 1, unknown, exclude_self=True, within=within).agg(F.count(F.lit(1)).alias("n_near"))
    # A row counts if some other row lies at a finite distance.
    finite = ready.agg(F.count_if(F.forall("numbers", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("n"))
    rows = finite.select(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("n_rows"))
    return rows.crossJoin(near).withColumn("rate", F.col("n_near") / F.col("n_rows"))


def twins(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Groups of rows equal in every feature but the read values, with their labels."""
    same = [c for c in spec.features if c not in spec.numerical]
    return (
        df.groupBy(*same)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(spec.label).cast("bigint")).alias("n_accepted"))
        .where(F.col("n_rows") > 1)
    )
