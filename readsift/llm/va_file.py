"""Exact top-k inner products with vector-approximation files.

Vectors lie in blocks. A block row holds the quantised cells of its vectors (one byte a component, on
a grid between the block's own extremes) and, in another column, the exact vectors. The first pass
reads only the cells: they bound every score from below and above, and the k-th best lower bound of a
query over all blocks is a score it certainly reaches. The second pass reads exact vectors of cells
whose upper bound reaches that, best bound first, until the k-th exact score beats every bound left.

Queries are blocks too, and every pair of blocks is met by an equi-join on a number of groups: data blocks
move once, query blocks once per group. No vector or bound of a vector reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from readsift.llm.common import tasks_for
from readsift.session import stage

LEVELS = 256
_EXACT = 2.0**53
_BLOCK = "dim int, n int, ids binary, low binary, step binary, cells binary, vectors binary"


def _as_bytes(matrix: np.ndarray) -> bytes:
    narrow = matrix.astype("<f4")
    return (narrow if np.array_equal(narrow, matrix) else matrix.astype("<f8")).tobytes()


def _as_matrix(stored: bytes, n: int, dim: int) -> np.ndarray:
    kind = "<f4" if len(stored) == 4 * n * dim else "<f8"
    return np.frombuffer(stored, dtype=kind).reshape(n, dim).astype(np.float64)


def _block(ids: list[int], matrix: np.ndarray) -> tuple:
    low = matrix.min(axis=0, initial=np.inf)
    step = np.maximum((matrix.max(axis=0, initial=-np.inf) - low) / LEVELS, np.finfo(np.float64).tiny)
    cells = np.minimum(np.floor((matrix - low) / step), LEVELS - 1).astype(np.uint8)
    n, dim = matrix.shape
    return dim, n, np.asarray(ids, "<i8").tobytes(), low.tobytes(), step.tobytes(), cells.tobytes(), _as_bytes(matrix)


def blocks(df: DataFrame, key: str, vector: str, scale: float, rows: int) -> DataFrame:
    """Rows of ``rows`` vectors each, components turned into floor(scale * x). Rows with a null key, and
    vectors that are null, empty or hold null or non-finite components, take no part. Vectors of other
    lengths go to blocks of their own."""
    fits = F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            full = []
            for k, v in zip(batch["key"], batch["vector"]):
                ids, vectors = waiting.setdefault(len(v), ([], []))
                ids.append(k)
                vectors.append(v)
                if len(ids) == rows:
                    full.append(_block(ids, np.floor(scale * np.asarray(vectors, np.float64))))
                    del waiting[len(v)]
            yield pd.DataFrame(full, columns=[f.split()[0] for f in _BLOCK.split(", ")])
        rest = [_block(ids, np.floor(scale * np.asarray(vs, np.float64))) for ids, vs in waiting.values()]
        yield pd.DataFrame(rest, columns=[f.split()[0] for f in _BLOCK.split(", ")])

    chosen = df.where(fits).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return chosen.mapInPandas(packed, _BLOCK)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum stays below 2**53."""
    reach = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if reach < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(vectors).T


def _bounds(queries: np.ndarray, row) -> tuple[np.ndarray, np.ndarray]:
    """Middle of the bounds of each (query, vector), and their distance from it per query."""
    low, step = np.frombuffer(row.low), np.frombuffer(row.step)
    cells = np.frombuffer(row.cells, np.uint8).reshape(row.n, row.dim)
    middle = queries @ (low + (cells + 0.5) * step).T
    # A little more than the grid needs, for the rounding of this arithmetic itself.
    reach = np.abs(queries) @ (step / 2) * (1 + 1e-6) + 1e-9 * (np.abs(queries) @ (np.abs(low) + LEVELS * step)) + 1e-6
    return middle, reach


class _Best:
    """The k best (value, id) per query of the query blocks that a task meets."""

    def __init__(self, k: int, held: int = 500) -> None:
        self._k, self._held, self._found = k, held, {}

    def add(self, query_ids: np.ndarray, q_block: int, found: list[list[tuple]]) -> None:
        ids, kept = self._found.setdefault(q_block, (query_ids, [[] for _ in query_ids]))
        for i, new in enumerate(found):
            if new:
                kept[i] = sorted(kept[i] + new, key=lambda x: (-x[0], x[1]))[: self._k]

    def rows(self, last: bool) -> list[tuple]:
        if not last and len(self._found) < self._held:
            return []
        rows = [(int(q), r[1], r[0]) for ids, kept in self._found.values() for q, best in zip(ids, kept) for r in best]
        self._found = {}
        return rows


def top_k(
    queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
    scale: float = 256.0, block_rows: int = 256,
) -> DataFrame:
    """The ``k`` rows of ``base`` with the greatest integer inner product for each query: rows (query_id,
    rank, ``key``, score), ties to the smaller key, a query's own key left out; all rows if fewer.

    Both sides go through :func:`blocks`, which says which vectors take part; a query and a vector of
    different lengths have no score. Repeated base rows each take a rank; repeated queries count once.
    Empty tables give no rows.
    """
    data = stage(blocks(base, key, vector, scale, block_rows), "va-file")
    asked = queries.dropDuplicates([key])
    # One shuffle keeps the few query blocks full, however the queries lay.
    asked = blocks(asked.repartition(max(1, -(-asked.count() // (16 * block_rows)))), key, vector, scale, block_rows)
    asked = stage(asked.select("dim", F.monotonically_increasing_id().alias("q_block"), F.col("n").alias("q_n"),
                               F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "va-queries")
    groups = max(1, min(data.count(), tasks_for(data)))
    spread = lambda d: d.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # Merged: the planner takes the copies for one table as small as a single one, and a broadcast would hold all of them on the driver.
    everywhere = lambda d: d.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).hint("merge")

    def lower_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for batch in batches:
            for row in batch.itertuples(index=False):
                asked_ids, ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
                middle, reach = _bounds(_as_matrix(row.q_vectors, row.q_n, row.dim), row)
                middle[asked_ids[:, None] == ids[None, :]] = -np.inf
                some = np.argpartition(-middle, min(k, row.n) - 1, axis=1)[:, :k]
                best.add(asked_ids, row.q_block, [
                    [(float(middle[i, j] - reach[i]), 0) for j in js if middle[i, j] > -np.inf] for i, js in enumerate(some)
                ])
            yield pd.DataFrame(best.rows(False), columns=["query_id", "_", "bound"])[["query_id", "bound"]]
        yield pd.DataFrame(best.rows(True), columns=["query_id", "_", "bound"])[["query_id", "bound"]]

    scanned = spread(data.select("dim", "n", "ids", "low", "step", "cells"))
    bounds = scanned.join(everywhere(asked), ["dim", "group"]).drop("group").mapInPandas(
        lower_bounds, "query_id bigint, bound double"
    )
    # At most k rows per task and query come here.
    reached = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    certain = stage(
        bounds.withColumn("_rank", F.row_number().over(reached)).where(F.col("_rank") == k).select("query_id", "bound"),
        "va-thresholds",
    )
    # One row per query block, with the thresholds of its at most block_rows queries.
    positions = asked.select("q_block", "q_ids", "q_n").mapInPandas(_query_ids, "q_block bigint, at int, query_id bigint")
    thresholds = positions.join(certain, "query_id", "left").groupBy("q_block").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")))),
            lambda x: x["bound"],
        ).alias("reached")
    )
    asked = stage(asked.join(thresholds, "q_block"), "va-queries")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        columns = ["query_id", "key", "score"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                asked_ids, ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
                vectors = _as_matrix(row.q_vectors, row.q_n, row.dim)
                middle, reach = _bounds(vectors, row)
                hopeful = (middle + reach[:, None] >= np.asarray(row.reached)[:, None]) & (asked_ids[:, None] != ids[None, :])
                own = None
                found = [[] for _ in asked_ids]
                for i in np.flatnonzero(hopeful.any(axis=1)):
                    own = _as_matrix(row.vectors, row.n, row.dim) if own is None else own
                    found[i] = _read_in_order(vectors[i], own, ids, middle[i], reach[i], np.flatnonzero(hopeful[i]), k)
                best.add(asked_ids, row.q_block, found)
            yield pd.DataFrame(best.rows(False), columns=columns)
        yield pd.DataFrame(best.rows(True), columns=columns)

    found = spread(data).join(everywhere(asked), ["dim", "group"]).drop("group").mapInPandas(
        exact, "query_id bigint, key bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("key").alias(key), "score")
    )


def _query_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(b, i, int(q)) for b, ids in zip(batch["q_block"], batch["q_ids"]) for i, q in enumerate(np.frombuffer(ids, "<i8"))]
        yield pd.DataFrame(rows, columns=["q_block", "at", "query_id"])


def _read_in_order(query, vectors, ids, middle, reach, hopeful, k: int, at_once: int = 16) -> list[tuple]:
    """The block's k best (score, id): exact vectors by falling bound, ``at_once`` at a time, until no bound
    left reaches the k-th score."""
    hopeful = hopeful[np.argsort(-middle[hopeful], kind="stable")]
    best: list[tuple] = []
    for i in range(0, len(hopeful), at_once):
        some = hopeful[i : i + at_once]
        if len(best) == k and middle[some[0]] + reach < best[-1][0]:
            break
        scores = _products(query[None, :], vectors[some])[0]
        best = sorted(best + [(int(s), int(ids[j])) for s, j in zip(scores, some)], key=lambda x: (-x[0], x[1]))[:k]
    return best
