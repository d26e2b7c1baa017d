"""k nearest neighbours as a learner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from readsift.operators.neighbours import nearest
from readsift.session import stage


@dataclass(frozen=True)
class NeighbourModel:
    base: DataFrame
    k: int
    unknown: int
    key: str

    def transform(self, df: DataFrame) -> DataFrame:
        """The search runs here, as it needs the queries."""
        queries = df.select(F.col(self.key).alias("id"), "hot", "numbers")
        votes = (
            nearest(queries, self.base, self.k, self.unknown)
            .groupBy("query_id")
            .agg(F.avg("label").alias("p1"))
            .withColumns({"score": F.col("p1"), "prediction": (F.col("p1") > 0.5).cast("int")})
        )
        return df.join(votes, F.col(self.key) == F.col("query_id")).drop("query_id")


@dataclass(frozen=True)
class Neighbours:
    """Uniform vote of the ``k`` nearest rows; rows are told apart by ``key``."""

    k: int = 5
    key: str = "row_idx"
    name: str = "neighbours"

    def fit(self, encoded: DataFrame, encoding) -> NeighbourModel:
        base = stage(encoded.select(F.col(self.key).alias("id"), "hot", "numbers", "label"), "neighbour-train")
        return NeighbourModel(base, self.k, encoding.width_hot, self.key)
