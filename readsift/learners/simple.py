"""Learners whose fit is one aggregation: dummy and Gaussian naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from readsift.learners.base import table_sum
from readsift.operators.encode import raw_numbers
from readsift.operators.exact import Total, binned_sums
from readsift.operators.rank import seeded_key
from readsift.session import stage


def class_counts(df: DataFrame) -> dict[int, int]:
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no training rows")
    return counts


@dataclass(frozen=True)
class DummyModel:
    strategy: str
    prior: float
    seed: int
    key: str

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "stratified":
            digits = F.conv(F.substring(seeded_key(self.seed, self.key), 1, 12), 16, 10).cast("double")
            p1 = F.when(digits / F.lit(float(16**12)) < self.prior, 1.0).otherwise(0.0)
        elif self.strategy == "most_frequent":
            p1 = F.lit(1.0 if self.prior > 0.5 else 0.0)
        else:
            p1 = F.lit(self.prior)
        return df.withColumns({"p1": p1, "score": p1, "prediction": (p1 > 0.5).cast("int")})


@dataclass(frozen=True)
class Dummy:
    """Ignores features. ``stratified`` draws from the class shares, seeded per row
    key; ``most_frequent`` and ``prior`` answer the bigger class."""

    strategy: str = "stratified"
    seed: int = 0
    key: str = "row_idx"
    name: str = "dummy"

    def fit(self, encoded: DataFrame, encoding) -> DummyModel:
        if self.strategy not in ("stratified", "most_frequent", "prior"):
            raise ValueError(f"unknown strategy {self.strategy}")
        counts = class_counts(encoded)
        return DummyModel(self.strategy, counts.get(1, 0) / sum(counts.values()), self.seed, self.key)


@dataclass(frozen=True)
class BayesModel:
    constant: dict[int, float]
    slot_change: dict[int, list[float]]
    number_stats: dict[int, list[tuple[float, float]]]

    def transform(self, df: DataFrame) -> DataFrame:
        logs = {}
        for c, constant in self.constant.items():
            total = F.lit(constant) + table_sum(self.slot_change[c])
            for i, (mean, variance) in enumerate(self.number_stats[c]):
                gap = F.get("numbers", F.lit(i)) - mean
                total = total - gap * gap / (2 * variance)
            logs[c] = total
        if set(logs) == {0, 1}:
            p1 = 1 / (1 + F.exp(F.least(logs[0] - logs[1], F.lit(700.0))))
        else:
            p1 = F.lit(1.0 if 1 in logs else 0.0)
        return df.withColumn("p1", p1).withColumns({"score": F.col("p1"), "prediction": (F.col("p1") > 0.5).cast("int")})


def bayes_tables(
    sizes: dict[int, int], hits: dict[int, np.ndarray], numbers: dict[int, list[tuple[float, float]]], smoothing: float
) -> BayesModel:
    """The model from rows per class, hits per class and slot, and (mean, variance) per class and number."""
    n, cells = sum(sizes.values()), range(len(next(iter(numbers.values()))))

    def overall_variance(i: int) -> float:
        mean = sum(sizes[c] * numbers[c][i][0] for c in sizes) / n
        return sum(sizes[c] * (numbers[c][i][1] + (numbers[c][i][0] - mean) ** 2) for c in sizes) / n

    share = sum(hits[c] for c in sizes) / n
    floor = smoothing * max([float((share * (1 - share)).max(initial=0.0))] + [overall_variance(i) for i in cells])
    constant, change, stats = {}, {}, {}
    for c, size in sizes.items():
        p = hits[c] / size
        v = p * (1 - p) + floor
        stats[c] = [(mean, variance + floor) for mean, variance in numbers[c]]
        constant[c] = math.log(size / n) + float((-0.5 * np.log(2 * math.pi * v) - p * p / (2 * v)).sum()) + sum(
            -0.5 * math.log(2 * math.pi * v) for _, v in stats[c]
        )
        # An unknown value has no slot.
        change[c] = [*((p * p - (1 - p) * (1 - p)) / (2 * v)).tolist(), 0.0]
    return BayesModel(constant, change, stats)


#: Weights of prefix models that one job scores by.
PREFIX_CELLS = 2_000_000
_NEVER = -1e300  # log probability of a class that a prefix has not seen
_SCORES = 1_000_000  # scores that a task has in memory at once


@dataclass(frozen=True)
class PrefixScores:
    """Log probabilities of several prefix models at once, over slots and unscaled numbers: per class a constant a
    model, a weight a slot and model, and a mean and twice a variance a number and model."""

    constant: list[np.ndarray]
    change: list[np.ndarray]
    mean: list[np.ndarray]
    spread: list[np.ndarray]

    @classmethod
    def of(cls, models: list, slots: int, numbers: int) -> "PrefixScores":
        found: tuple[list, ...] = ([], [], [], [])
        for c in (0, 1):
            parts: tuple[list, ...] = ([], [], [], [])
            for m in models:
                if isinstance(m, BayesModel):
                    own = m.constant[c], m.slot_change[c], [x for x, _ in m.number_stats[c]], [2 * v for _, v in m.number_stats[c]]
                else:
                    own = 0.0 if m.prior == c else _NEVER, [0.0] * slots, [0.0] * numbers, [1e300] * numbers
                for part, x in zip(parts, own):
                    part.append(x)
            for to, part in zip(found, parts):
                to.append(np.ascontiguousarray(np.array(part, float).T))
        return cls(*found)

    def called(self, hot: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether each model (column) calls each row 1."""
        totals = []
        with np.errstate(all="ignore"):
            for constant, change, mean, spread in zip(self.constant, self.change, self.mean, self.spread):
                total = np.zeros((len(hot), len(constant)))
                for j in range(hot.shape[1]):
                    total += change[hot[:, j]]
                total += constant
                away = np.zeros_like(total)
                for j in range(numbers.shape[1]):
                    gap = numbers[:, j][:, None] - mean[j]
                    away += gap * gap / spread[j]
                totals.append(total - away)
            # What is no number counts as larger than any.
            return (totals[1] > totals[0]) | (np.isnan(totals[1]) & ~np.isnan(totals[0]))


def _count_prefixes(df: DataFrame, parts: list[tuple[int, int, int, int]], index: str, models: list, spec, slots: int) -> DataFrame:
    """(part, split, label, prediction, n): how rows (``index``, hot, numbers of ``spec``, label) are called.

    ``parts`` are (at, stop, start, end): the rows before ``stop`` are train, those from ``start`` to ``end`` test, and the
    model at ``at`` calls them. Every task counts its rows batch by batch, for all parts.
    """
    numbers = len(spec.numerical) + len(spec.passthrough)
    sent = df.sparkSession.sparkContext.broadcast(PrefixScores.of(models, slots, numbers))
    room = max(1, _SCORES // len(models))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), room):
                rows = batch.iloc[first : first + room]
                hot = np.array(rows["hot"].tolist(), np.int64).reshape(len(rows), -1)
                values = np.array(rows["numbers"].tolist(), float).reshape(len(rows), -1)
                at, label = rows["at"].to_numpy(), rows["label"].to_numpy(float, na_value=np.nan)
                called = sent.value.called(hot, values)
                codes, kinds = pd.factorize(label, use_na_sentinel=False)
                made = []
                for part, (model, stop, start, end) in enumerate(parts):
                    cell = 2 * codes + called[:, model]
                    train = at < stop
                    for split, mine in (("train", train), ("test", ~train & (at >= start) & (at < end))):
                        counts = np.bincount(cell[mine], minlength=2 * len(kinds))
                        made += [(part, split, kinds[i // 2], i % 2, counts[i]) for i in np.flatnonzero(counts)]
                found = pd.DataFrame(made, columns=["part", "split", "label", "prediction", "n"])
                yield found.astype({"label": "Int64", "part": "int64", "prediction": "int64", "n": "int64"})

    wanted = df.select(F.col(index).cast("bigint").alias("at"), "hot", raw_numbers(spec).alias("numbers"), F.col("label").cast("int").alias("label"))
    return wanted.mapInPandas(count, "part int, split string, label int, prediction int, n bigint")


@dataclass(frozen=True)
class NaiveBayes:
    """Gaussian per class and encoded feature, variances from one aggregation.

    A one-hot slot with share p has mean p and variance p(1 - p), so counts per
    (class, slot) suffice. ``smoothing`` times the largest variance of any feature
    is added to every variance.
    """

    smoothing: float = 1e-9
    name: str = "bayes"

    def prefix_counters(self, encoded: DataFrame, encoding, stops: list[int], index: str) -> Iterator[tuple[list[int], Callable]]:
        """Groups of prefixes and what counts rows called by them, so many at once as ``PREFIX_CELLS`` weights allow."""
        room = max(1, PREFIX_CELLS // (2 * (encoding.width_hot + 1)))
        models = self.fit_prefixes(encoded, encoding, stops, index)
        while group := list(islice(models, room)):
            yield [stop for stop, _ in group], partial(
                _count_prefixes, index=index, models=[m for _, m in group], spec=encoding.spec, slots=encoding.width_hot + 1
            )

    def fit(self, encoded: DataFrame, encoding) -> BayesModel:
        cells = range(encoding.width_numbers)
        number = [F.get("numbers", F.lit(i)) for i in cells]
        per_class = {
            r["label"]: r
            for r in encoded.groupBy("label").agg(
                F.count(F.lit(1)).alias("rows"),
                *[F.avg(x).alias(f"m{i}") for i, x in enumerate(number)],
                *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(number)],
            ).collect()
        }
        if not per_class:
            raise ValueError("no training rows")
        hits = {c: np.zeros(encoding.width_hot) for c in per_class}
        for r in (
            encoded.select("label", F.explode("hot").alias("slot")).where(F.col("slot") < encoding.width_hot)
            .groupBy("label", "slot").agg(F.count(F.lit(1)).alias("n")).collect()
        ):
            hits[r["label"]][r["slot"]] = r["n"]
        numbers = {c: [(r[f"m{i}"], r[f"v{i}"]) for i in cells] for c, r in per_class.items()}
        return bayes_tables({c: r["rows"] for c, r in per_class.items()}, hits, numbers, self.smoothing)

    def fit_prefixes(self, encoded: DataFrame, encoding, stops: list[int], index: str) -> Iterator[tuple[int, BayesModel | DummyModel]]:
        """(stop, model of the rows before it) for rising stops, from one pass of sums per window between two stops.

        Running totals of the windows are those of every prefix. Each model scales numbers by its own rows, as a fit of
        them alone would. The driver holds one window's counts at a time.
        """
        columns = [f"_x{i}" for i in range(encoding.width_numbers)]
        raw, scaled = raw_numbers(encoding.spec), len(encoding.spec.numerical)
        window = F.size(F.filter(F.array(*map(F.lit, stops)), lambda s: s <= F.col(index))).alias("window")
        rows = stage(
            encoded.where(F.col(index) < max(stops)).select(window, "label", "hot", *[F.get(raw, F.lit(i)).alias(c) for i, c in enumerate(columns)]),
            "windows",
        )
        sums: dict[int, dict] = {}
        for r in binned_sums(rows, columns, ["window", "label"]).collect():
            sums.setdefault(r["window"], {}).setdefault(r["label"], {}).setdefault(r["column"], Total()).add(r)
        counts: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("window", "label").agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["window"], {})[r["label"]] = r["n"]
        slots = rows.select("window", "label", F.explode("hot").alias("slot")).where(F.col("slot") < encoding.width_hot)
        # As many groups as the windows have different slots; read back window by window.
        held = stage(slots.groupBy("window", "label", "slot").agg(F.count(F.lit(1)).alias("n")).orderBy("window"), "window-slots")
        sizes: dict[int, int] = {}
        hits: dict[int, np.ndarray] = {}
        totals: dict[int, dict[str, Total]] = {}
        by_window = groupby(held.orderBy("window").toLocalIterator(), key=lambda r: r["window"])
        waiting = next(by_window, None)
        for at, stop in enumerate(stops):
            for c, n in counts.get(at, {}).items():
                sizes[c] = sizes.get(c, 0) + n
                hits.setdefault(c, np.zeros(encoding.width_hot))
                own = totals.setdefault(c, {x: Total() for x in columns})
                for x, total in sums.get(at, {}).get(c, {}).items():
                    own[x] = own[x] + total
            if waiting and waiting[0] == at:
                for r in waiting[1]:
                    hits[r["label"]][r["slot"]] += r["n"]
                waiting = next(by_window, None)
            if len(sizes) == 1:
                yield stop, DummyModel("most_frequent", float(next(iter(sizes))), 0, "")
            elif sizes:
                yield stop, self._prefix_model(dict(sizes), {c: h.copy() for c, h in hits.items()}, totals, columns, scaled)

    def _prefix_model(self, sizes, hits, totals, columns, scaled) -> BayesModel:
        whole = {x: sum((totals[c][x] for c in sizes), Total()) for x in columns}
        shift = {x: (whole[x].mean, whole[x].deviation or 1.0) if i < scaled else (0.0, 1.0) for i, x in enumerate(columns)}
        numbers = {
            c: [((totals[c][x].mean - shift[x][0]) / shift[x][1], (totals[c][x].deviation / shift[x][1]) ** 2) for x in columns] for c in sizes
        }
        model = bayes_tables(sizes, hits, numbers, self.smoothing)
        # The same densities on the numbers as they are, whose differences are larger by the scale.
        for c, stats in model.number_stats.items():
            model.number_stats[c] = [(m * shift[x][1] + shift[x][0], v * shift[x][1] ** 2) for x, (m, v) in zip(columns, stats)]
        return model
