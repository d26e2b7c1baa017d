"""Helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from readsift.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all other characters as they are. Words of ASCII alone take the
    fast built-in; ``translate`` goes character by character."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, _UPPER, _LOWER)
    )


def if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (the join
    then shuffles both sides, and adaptive execution splits its hot keys).

    ``df`` should be staged: counting it is then a look at file footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def tasks_for(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session, as a plain number."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the component
    being its smallest node. Nodes without an edge don't occur.

    Each round hooks every node to its smallest neighbour, halves the paths so made until all
    point at a root, and contracts the edges to their roots. Edges shrink from round to round,
    long chains take a logarithmic number of halvings, and a hub is only ever the key of a
    minimum (combined before the shuffle) or of a join with one row on the other side. All of it
    stays in staged tables.

    Nulls are no nodes; loops and repeated edges change nothing; no edges give no rows.
    """
    edges = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
        parent = stage(parent, "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            # Every root is a node, so the inner join keeps all rows.
            jumped = parent.join(up, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
            jumped = stage(jumped, "parents")
            moved = not jumped.where("_moved").isEmpty()
            parent = jumped.drop("_moved")
            if not moved:
                break
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(parent.withColumnsRenamed({"node": side, "root": f"_{side}"}), side)
        edges = stage(
            ends.where("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .distinct(),
            "edges",
        )
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = stage(
                labels.join(up, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "labels"
            )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.withColumnRenamed("root", "component")
