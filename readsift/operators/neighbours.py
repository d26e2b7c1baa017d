"""Exact nearest neighbours of mixed rows, by agreement of column classes.

The distance is the Euclidean one over one-hot categoricals and scaled numbers,
taken from the compact columns ``hot`` and ``numbers``: a category only one of two
rows has costs 1, so two known ones that differ cost 2.

A few base rows are held by every task. Many are searched level by level. A level cuts the columns into g classes of
about equal information; two rows that differ in at most g - 2 of the columns agree in at least two whole classes, so
they meet under one of the level's pairs of classes. Queries keep their k best so far, which bound the columns that a
nearer row may differ in; a query is done at the first level that covers its bound, and one that no level covers meets
all rows. Rows of a pair of classes are dealt by a hash of their categories to units of bounded size, and larger units
are cut into blocks of rows and chunks of queries, however many rows or queries crowd one value. Only the k best of a
unit leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from readsift.session import stage

_DIGITS = 9  # Distances equal to this many places count as ties, broken by id.
_SLACK = 1e-6  # Keeps a row whose bound misses the reach by rounding alone.
#: Base rows that every task may hold: some 250 bytes each, so about 10 MB. More go through the levels.
HELD_ROWS = 40_000
_CELLS = 8_000_000  # distances that a task has in memory at once
#: Numbers of column classes, level by level.
CLASSES = (6, 8, 10, 13)
#: Base rows of a unit; more than this share of all rows met at a level is no better than meeting all.
UNIT_ROWS, MOST_MET = 512, 0.5
#: Pairs of rows that cost as much as one more copy of a row: few queries meet all rows at once.
COPY_PAIRS = 1500
#: Rows that choose the classes; no result depends on them.
SAMPLE_ROWS = 20_000


def _matrix(column, kind) -> np.ndarray:
    return np.array(column.tolist(), dtype=kind).reshape(len(column), -1)


def squared_distances(hot_a, num_a, hot_b, num_b, unknown: int) -> np.ndarray:
    """All distances between two blocks of rows.

    Rows that share s of their a and b known categories differ by a + b - 2s; the
    shared ones are counted by a product of 0/1 matrices over the common slots.
    """
    known_a, known_b = hot_a != unknown, hot_b != unknown
    common = np.intersect1d(hot_a[known_a], hot_b[known_b])
    shared = _membership(hot_a, common) @ _membership(hot_b, common).T
    total = known_a.sum(axis=1)[:, None] + known_b.sum(axis=1)[None, :] - 2.0 * shared
    for j in range(num_a.shape[1]):
        gap = num_a[:, j][:, None] - num_b[:, j][None, :]
        total += gap * gap
    return total


def _membership(hot: np.ndarray, slots: np.ndarray) -> np.ndarray:
    member = np.zeros((len(hot), len(slots)), dtype=np.float32)
    if len(slots):
        at = np.searchsorted(slots, hot)
        inside = (at < len(slots)) & (slots[np.minimum(at, len(slots) - 1)] == hot)
        member[np.nonzero(inside)[0], at[inside]] = 1.0
    return member


_FOUND = "query_id long, neighbour_id long, d2 double, label double"


def _bounds_below(hot_a, num_a, hot_b, num_b, unknown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single-precision lower bounds of all distances, from one product, and by how much either row may lie too low."""
    known_a, known_b = hot_a != unknown, hot_b != unknown
    common = np.intersect1d(hot_a[known_a], hot_b[known_b])
    left = np.hstack([_membership(hot_a, common), num_a.astype(np.float32)])
    right = np.hstack([_membership(hot_b, common), num_b.astype(np.float32)])
    norm_a, norm_b = known_a.sum(axis=1) + (num_a * num_a).sum(axis=1), known_b.sum(axis=1) + (num_b * num_b).sum(axis=1)
    # A product of w terms errs by less than w units of 2^-24 of the norms; rounding of the numbers and sums adds a few.
    slack = (left.shape[1] + 16) * 2.0**-22
    low = left @ right.T
    low *= -2
    low += (norm_a * (1 - slack)).astype(np.float32)[:, None]
    low += (norm_b * (1 - slack)).astype(np.float32)[None, :]
    return low, 2 * slack * norm_a, 2 * slack * norm_b


def _exact(hot_a, num_a, hot_b, num_b, unknown: int) -> np.ndarray:
    """Distances of pairs of rows, as :func:`squared_distances` has them."""
    known_a, known_b = hot_a != unknown, hot_b != unknown
    shared = ((hot_a[:, :, None] == hot_b[:, None, :]) & known_a[:, :, None]).any(axis=2).sum(axis=1)
    total = known_a.sum(axis=1) + known_b.sum(axis=1) - 2.0 * shared
    for j in range(num_a.shape[1]):
        gap = num_a[:, j] - num_b[:, j]
        total += gap * gap
    return total


_PAIRS = 50_000  # pairs whose slots are compared at once


def _k_best(queries, base, k: int, unknown: int, exclude_self: bool) -> pd.DataFrame:
    """The k best of ``base`` for each query, within its reach.

    Both are (id, hot, numbers, label or reach); ``base`` is sorted by id.
    """
    query_ids, hot_a, num_a, reach = queries
    ids, hot_b, num_b, label = base
    with np.errstate(all="ignore"):
        low, slack_a, slack_b = _bounds_below(hot_a, num_a, hot_b, num_b, unknown)
        plain = not (np.isfinite(low).all() and np.isfinite(slack_a).all() and np.isfinite(slack_b).all())
        if plain:  # numbers too large for single precision, or not finite
            low = squared_distances(hot_a, num_a, hot_b, num_b, unknown)
            low[~np.isfinite(low)] = np.inf
            slack_a, slack_b = np.full(len(low), _SLACK), np.zeros(1)
    if exclude_self:
        first, last = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
        for i in np.flatnonzero(last > first):
            low[i, first[i] : last[i]] = np.inf
    # Only what may be among the k best, or nearer than the k best so far, is computed exactly.
    spare = slack_a + slack_b.max() + _SLACK
    upto = reach + _SLACK
    if low.shape[1] > k and not (np.isfinite(upto).all() and np.count_nonzero(low <= upto[:, None]) <= 8 * k * len(low)):
        upto = np.minimum(upto, np.partition(low, k - 1, axis=1)[:, k - 1] + spare)
    row, col = np.nonzero((low <= upto[:, None]) & (low < np.inf))
    d2 = np.empty(len(row))
    for at in range(0, len(row), _PAIRS):
        r, c = row[at : at + _PAIRS], col[at : at + _PAIRS]
        d2[at : at + _PAIRS] = low[r, c] if plain else _exact(hot_a[r], num_a[r], hot_b[c], num_b[c], unknown)
    d2 = np.round(d2, _DIGITS)
    order = np.lexsort((ids[col], d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (nth < k) & (d2 <= reach[row] + _SLACK)
    row, col, d2 = row[kept], col[kept], d2[kept]
    return pd.DataFrame({"query_id": query_ids[row], "neighbour_id": ids[col], "d2": d2, "label": label[col]})


@dataclass(frozen=True)
class _Shape:
    """How a row is packed: so many slots of four bytes, then so many numbers of eight."""

    slots: int
    numbers: int

    def pack(self, hot: np.ndarray, numbers: np.ndarray) -> list[bytes]:
        rows = np.hstack([hot.astype("<i4").view(np.uint8).reshape(len(hot), 4 * self.slots), numbers.astype("<f8").view(np.uint8).reshape(len(hot), 8 * self.numbers)])
        return [r.tobytes() for r in rows]

    def unpack(self, column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 4 * self.slots + 8 * self.numbers)
        hot = np.ascontiguousarray(rows[:, : 4 * self.slots]).view("<i4").reshape(len(rows), self.slots)
        return hot.astype(np.int64), np.ascontiguousarray(rows[:, 4 * self.slots :]).view("<f8").reshape(len(rows), self.numbers)

    def packed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``row`` in place of ``hot`` and ``numbers``."""
        rest = [f for f in rows.schema if f.name not in ("hot", "numbers")]

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    row = self.pack(_matrix(pdf["hot"], np.int64), _matrix(pdf["numbers"], float))
                    yield pdf[[f.name for f in rest]].assign(row=row)

        return rows.mapInPandas(one, StructType([*rest, StructField("row", BinaryType())]))


def _best_of_block(k: int, unknown: int, exclude_self: bool, shape: _Shape):
    def best(_key, queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or base.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "neighbour_id", "d2", "label")}).astype(
                {"query_id": "int64", "neighbour_id": "int64", "d2": "float64", "label": "float64"}
            )
        base = base.sort_values("id")
        held = (base["id"].to_numpy(), *shape.unpack(base["row"]), base["label"].to_numpy(float))
        asked = (queries["id"].to_numpy(), *shape.unpack(queries["row"]), queries["reach"].to_numpy(float))
        return _k_best(asked, held, k, unknown, exclude_self)

    return best


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("d2", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return _top(found, k).select("query_id", "neighbour_id", "rank", F.sqrt("d2").alias("distance"), "label")


def _held_search(queries: DataFrame, base: DataFrame, n: int, k: int, unknown: int, exclude_self: bool, reach: float) -> DataFrame:
    """Every task holds the whole small base; queries are read once and nothing is shuffled but them."""
    rows = base.toPandas().sort_values("id")
    table = (rows["id"].to_numpy(), _matrix(rows["hot"], np.int64), _matrix(rows["numbers"], float), rows["label"].to_numpy(float))
    held = base.sparkSession.sparkContext.broadcast(table)
    step = max(16, _CELLS // n)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at : at + step]
                asked = (some["id"].to_numpy(), _matrix(some["hot"], np.int64), _matrix(some["numbers"], float), np.full(len(some), reach))
                yield _k_best(asked, held.value, k, unknown, exclude_self)

    most = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, queries.count() * n // (10 * _CELLS) + 1))
    return queries.repartition(tasks).mapInPandas(search, _FOUND)


def _search(visits: DataFrame, lists: DataFrame, k, unknown, exclude_self, shape, block_rows, chunk_rows) -> DataFrame:
    """k best base rows per query and pair of block and chunk, among the units it visits.

    ``visits``: (unit, id, row, reach) of queries; ``lists``: the same of base rows, with label. The sizes of both
    sides of a unit are counted and joined to the other side, which is copied once per block or chunk.
    """
    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = stage(parts(lists, block_rows, "blocks").join(parts(visits, chunk_rows, "chunks"), "unit"), "unit-sizes")
    asked = (
        visits.join(sizes, "unit")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    )
    held = (
        lists.join(sizes, "unit")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks").cast("bigint") - 1)))
    )
    unit = ["unit", "block", "chunk"]
    return (
        asked.select(*unit, "id", "row", "reach")
        .groupBy(*unit)
        .cogroup(held.select(*unit, "id", "row", "label").groupBy(*unit))
        .applyInPandas(_best_of_block(k, unknown, exclude_self, shape), _FOUND)
    )


@dataclass(frozen=True)
class _Level:
    """Columns, told apart by their lowest slots, in classes; units of rows that agree in a pair of classes."""

    firsts: np.ndarray
    class_of: np.ndarray
    classes: int
    unknown: int

    def hashes(self, hot: np.ndarray) -> np.ndarray:
        """A hash of the slots that each row has in each class."""
        mixed = (hot.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mine = np.where(hot == self.unknown, -1, self.class_of[np.searchsorted(self.firsts, hot, "right")])
        return np.stack([np.where(mine == c, mixed, np.uint64(0)).sum(axis=1, dtype=np.uint64) for c in range(self.classes)], axis=1)

    def pairs(self, hot: np.ndarray) -> Iterator[np.ndarray]:
        found = self.hashes(hot)
        for i, j in combinations(range(self.classes), 2):
            both = (found[:, i] * np.uint64(0x94D049BB133111EB)) ^ (found[:, j] + np.uint64(0x2545F4914F6CDD1D))
            both = (both ^ (both >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            yield both ^ (both >> np.uint64(32))

    def units(self, rows: DataFrame, shape: _Shape, parts: int) -> DataFrame:
        """``rows`` once per pair of classes, with the unit that its values there are dealt to."""

        @F.pandas_udf("array<long>")
        def of(row: pd.Series) -> pd.Series:
            if row.empty:
                return pd.Series([], dtype=object)
            hot, _ = shape.unpack(row)
            units = [p * parts + (pair % np.uint64(parts)).astype(np.int64) for p, pair in enumerate(self.pairs(hot))]
            return pd.Series(list(np.stack(units, axis=1)))

        return rows.withColumn("unit", F.explode(of("row")))


def _odd_groups(hot: np.ndarray, firsts: np.ndarray, unknown: int) -> np.ndarray:
    """Columns of which a row has no slot, or several: only there can a difference cost less than 2."""
    column = np.searchsorted(firsts, hot, "right")
    one = np.zeros((len(hot), len(firsts) + 1), np.int64)
    np.add.at(one, (np.repeat(np.arange(len(hot)), hot.shape[1]), column.ravel()), (hot != unknown).ravel())
    return (one != 1).sum(axis=1)


def _levels(base: DataFrame, sample: np.ndarray, firsts: np.ndarray, unknown: int) -> list[_Level]:
    """Levels of the sizes in ``CLASSES`` whose units hold few enough of the rows.

    ``sample`` only deals the columns to classes and estimates units; every choice finds the same rows.
    """
    columns = len(firsts) + 1
    column = np.where(sample == unknown, -1, np.searchsorted(firsts, sample, "right"))
    value = np.stack([np.where(column == c, sample + 1, 0).sum(axis=1) for c in range(columns)], axis=1)

    def entropy(*of: np.ndarray) -> float:
        count = np.unique(np.stack(of, axis=1), axis=0, return_counts=True)[1] / len(sample)
        return float(-(count * np.log2(count)).sum())

    # Columns that another one nearly decides go to the class of that one.
    alone = [entropy(value[:, c]) for c in range(columns)]
    leaders: list[list[int]] = []
    for c in sorted(range(columns), key=lambda c: -alone[c]):
        led = next((own for own in leaders if entropy(value[:, own[0]], value[:, c]) - alone[own[0]] <= alone[c] / 8), None)
        if led is not None:
            led.append(c)
        else:
            leaders.append([c])
    found = []
    for classes in CLASSES:
        if classes > len(leaders):
            break
        load, class_of = [0.0] * classes, np.zeros(columns, np.int64)
        for own in leaders:
            least = min(range(classes), key=lambda i: load[i])
            load[least] += alone[own[0]] + 0.01
            class_of[own] = least
        level = _Level(firsts, class_of, classes, unknown)
        met = sum(float(((np.unique(p, return_counts=True)[1] / len(sample)) ** 2).sum()) for p in level.pairs(sample))
        if met <= MOST_MET:
            found.append(level)
    return found


def _listed_search(
    queries: DataFrame, base: DataFrame, n: int, k: int, unknown: int, exclude_self: bool, block_rows: int, chunk_rows: int, reach: float,
    copy_pairs: int,
) -> DataFrame:
    slots, numbers = base.select(F.max(F.size("hot")), F.max(F.size("numbers"))).first()
    shape = _Shape(slots, numbers)
    known = F.size(F.filter("hot", lambda s: s != unknown))
    most = base.agg(F.max(known)).first()[0]
    lowest = base.where(known == most).agg(F.lit(0), *[F.min(F.get("hot", F.lit(i))) for i in range(1, most)]).first()
    firsts = np.array(lowest[1:], np.int64)

    @F.pandas_udf("long")
    def odd(hot: pd.Series) -> pd.Series:
        return pd.Series(_odd_groups(_matrix(hot, np.int64), firsts, unknown) if len(hot) else [], dtype="int64")

    loose = base.agg(F.max(odd("hot"))).first()[0]
    base_rows = stage(shape.packed(base.select("id", "label", "hot", "numbers")), "neighbour-base")
    asked = queries.withColumn("loose", odd("hot") + loose)
    open_rows = stage(shape.packed(asked.select("id", "loose", F.lit(reach).alias("reach"), "hot", "numbers")), "neighbour-queries")
    drawn = base.sample(min(1.0, 2.0 * SAMPLE_ROWS / n), 0).limit(SAMPLE_ROWS).select("hot").toPandas()
    levels = _levels(base, _matrix(drawn["hot"], np.int64), firsts, unknown) if len(drawn) else []
    args = (k, unknown, exclude_self, shape, block_rows, chunk_rows)
    parts, found = max(1, n // UNIT_ROWS), None

    # Where a column costs 1 at ``loose`` places at most and 2 elsewhere, so many may differ within the reach.
    spent = F.col("reach") + _SLACK
    differ = F.floor(F.least(spent, F.col("loose")) + F.greatest(spent - F.col("loose"), F.lit(0)) / 2)
    left = open_rows.count()
    for level in [*levels, None]:
        pairs = level.classes * (level.classes - 1) // 2 if level is not None else 0
        if left * n <= (left + n) * pairs * copy_pairs:
            level = None
        if level is not None:
            more = _search(level.units(open_rows, shape, parts), level.units(base_rows, shape, parts), *args)
        else:
            more = _search(open_rows.withColumn("unit", F.lit(0)), base_rows.withColumn("unit", F.lit(0)), *args)
        met = more if found is None else found.unionByName(more)
        found = stage(_top(met.dropDuplicates(["query_id", "neighbour_id"]), k).drop("rank"), "neighbour-found")
        if level is None:
            break
        kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("kth"))
        bounded = open_rows.join(kth, open_rows["id"] == kth["query_id"], "left").withColumn("reach", F.least("reach", "kth"))
        open_rows = stage(bounded.where(~F.coalesce(differ <= level.classes - 2, F.lit(False))).drop("query_id", "kth"), "neighbour-open")
        left = open_rows.count()
        if not left:
            break
    return found


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    unknown: int,
    exclude_self: bool = False,
    block_rows: int = 2048,
    chunk_rows: int = 2048,
    held_rows: int = HELD_ROWS,
    within: float | None = None,
    copy_pairs: int = COPY_PAIRS,
) -> DataFrame:
    """(query_id, neighbour_id, rank, distance, label) of the k nearest base rows.

    Both frames need ``id`` (unique bigint), ``hot`` and ``numbers``; ``base`` may
    carry ``label``. Equal distances rank by id. A base of up to ``held_rows`` different rows is held by every task, a
    larger one is searched by levels; the rows found are the same. With ``within`` only rows at most so far away count.
    """
    if "label" not in base.columns:
        base = base.withColumn("label", F.lit(None).cast("double"))
    # Of identical rows only the first k (one more if a row may meet itself) can
    # be neighbours; the rank filter already cuts them before the shuffle.
    copies = Window.partitionBy("hot", "numbers").orderBy("id")
    base = stage(
        base.select("id", "hot", "numbers", F.col("label").cast("double").alias("label"))
        .withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= k + int(exclude_self))
        .drop("_copy"),
        "neighbour-base",
    )
    n = base.count()
    if n == 0:
        return base.sparkSession.createDataFrame([], "query_id long, neighbour_id long, rank int, distance double, label double")
    queries = stage(queries.select("id", "hot", "numbers"), "neighbour-queries")
    reach = float("inf") if within is None else float(within) ** 2
    if n <= held_rows:
        # A query meets the whole base in one task, so what it found there is final but for the rank.
        found = _ranked(_held_search(queries, base, n, k, unknown, exclude_self, reach), k)
    else:
        found = _ranked(_listed_search(queries, base, n, k, unknown, exclude_self, block_rows, chunk_rows, reach, copy_pairs), k)
    return found if within is None else found.where(F.col("distance") <= within)
