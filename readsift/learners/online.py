"""Linear learners trained by iterative parameter mixing.

Each round starts every shard of the rows from the shared weights; a shard runs the
update rule over its rows in a fixed order and returns its weights; their average,
weighted by rows and taken by Spark, starts the next round (McDonald, Hall and
Mann, 2010). Shards follow from the number of rows alone, so neither the session's
partitions nor the packing of files into tasks changes a fit. A task holds one Arrow
batch at a time, the driver one weight vector.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby
from math import ceil
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from readsift.learners.base import table_sum
from readsift.learners.simple import DummyModel, class_counts
from readsift.operators.exact import exact_sum
from readsift.operators.rank import seeded_key
from readsift.session import stage

_BATCH = 64
SHARD_ROWS = 50_000


@dataclass
class Weights:
    """Slot weights (the last one, for unknown values, stays 0), number weights, bias."""

    slots: np.ndarray
    numbers: np.ndarray
    bias: float

    @classmethod
    def zero(cls, width_hot: int, width_numbers: int) -> "Weights":
        return cls(np.zeros(width_hot + 1), np.zeros(width_numbers), 0.0)

    @classmethod
    def of(cls, flat: np.ndarray, width_hot: int) -> "Weights":
        return cls(flat[: width_hot + 1].copy(), flat[width_hot + 1 : -1].copy(), float(flat[-1]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.slots, self.numbers, [self.bias]])

    def margin(self, hot: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return self.slots[hot].sum(axis=1) + numbers @ self.numbers + self.bias

    def add(self, hot: np.ndarray, numbers: np.ndarray, step: np.ndarray) -> None:
        """Add ``step[i]`` times row i, for all rows of a batch."""
        per_slot = np.bincount(hot.ravel(), np.repeat(step, hot.shape[1]), len(self.slots))
        per_slot[-1] = 0.0
        self.slots += per_slot
        self.numbers += step @ numbers
        self.bias += step.sum()

    def shrink(self, factor: float, cut: float) -> None:
        for w in (self.slots, self.numbers):
            w *= factor
            if cut:
                np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - cut, 0.0))


# An update rule takes weights, one batch (slots, numbers, side in {-1, +1}) and
# the rows seen so far, changes the weights and returns the batch's summed loss.
Rule = Callable[[Weights, np.ndarray, np.ndarray, np.ndarray, float], float]


def perceptron_rule(alpha: float, penalty: str, eta: float) -> Rule:
    def update(w, hot, numbers, side, seen):
        margin = side * w.margin(hot, numbers)
        wrong = margin <= 0
        if penalty == "l2":
            w.shrink(max(0.0, 1.0 - eta * alpha), 0.0)
        w.add(hot, numbers, eta * side * wrong / len(side))
        if penalty == "l1":
            w.shrink(1.0, eta * alpha)
        return float(np.maximum(-margin, 0.0).sum())

    return update


def passive_aggressive_rule(c: float) -> Rule:
    """One step a row, as large as the row needs and ``c`` allows. An unknown value has no weight, so it adds nothing
    to the row's norm."""

    def update(w, hot, numbers, side, seen):
        norm = (hot < len(w.slots) - 1).sum(axis=1) + (numbers * numbers).sum(axis=1)
        total = 0.0
        for i in range(len(side)):
            row = slice(i, i + 1)
            loss = max(1.0 - side[i] * float(w.margin(hot[row], numbers[row])[0]), 0.0)
            if loss:
                w.add(hot[row], numbers[row], side[row] * min(c, loss / max(norm[i], 1e-12)))
                total += loss
        return total

    return update


def hinge_rule(alpha: float, l1_ratio: float) -> Rule:
    """Hinge loss with elastic net; the step falls as 1 / (alpha (t0 + t))."""
    typical = np.sqrt(1.0 / np.sqrt(alpha))
    first = 1.0 / (typical * alpha)

    def update(w, hot, numbers, side, seen):
        eta = 1.0 / (alpha * (first + seen))
        loss = np.maximum(1.0 - side * w.margin(hot, numbers), 0.0)
        w.shrink(max(0.0, 1.0 - eta * alpha * (1.0 - l1_ratio)), 0.0)
        w.add(hot, numbers, eta * side * (loss > 0) / len(side))
        w.shrink(1.0, eta * alpha * l1_ratio)
        return float(loss.sum())

    return update


@dataclass(frozen=True)
class LinearModel:
    slots: list[float]
    numbers: list[float]
    bias: float
    rounds: int

    def transform(self, df: DataFrame) -> DataFrame:
        margin = table_sum(self.slots) + F.lit(self.bias)
        for i, w in enumerate(self.numbers):
            margin = margin + F.get("numbers", F.lit(i)) * w
        return df.withColumn("score", margin).withColumns(
            {"prediction": (F.col("score") > 0).cast("int"), "p1": F.lit(None).cast("double")}
        )


_PART_SCHEMA = "w array<double>, n double, loss double, held double, hits double"


def _one_round(start: np.ndarray, width_hot: int, rule: Rule, seen_before: float):
    """Task of one round: judge the starting weights on held-out rows, train each shard's own on the rest.

    A shard is one file, sorted, and not split; a task may read several."""

    def shard(parts):
        shared, w = Weights.of(start, width_hot), Weights.of(start, width_hot)
        rows, loss, held, hits = 0, 0.0, 0, 0
        for pdf in parts:
            hot = np.array(pdf["hot"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
            numbers = np.array(pdf["numbers"].tolist(), dtype=float).reshape(len(pdf), -1)
            side = 2.0 * pdf["label"].to_numpy() - 1.0
            out = pdf["held_out"].to_numpy(dtype=bool)
            if out.any():
                held += int(out.sum())
                hits += int(((shared.margin(hot[out], numbers[out]) > 0) == (side[out] > 0)).sum())
                hot, numbers, side = hot[~out], numbers[~out], side[~out]
            for at in range(0, len(side), _BATCH):
                cut = slice(at, at + _BATCH)
                loss += rule(w, hot[cut], numbers[cut], side[cut], seen_before + rows)
                rows += len(side[cut])
        return pd.DataFrame(
            {"w": [w.flat().tolist()], "n": [float(rows)], "loss": [loss], "held": [float(held)], "hits": [float(hits)]}
        )

    def run(batches):
        pieces = (piece for pdf in batches for piece in pdf.groupby("shard", sort=False))
        for _, parts in groupby(pieces, key=itemgetter(0)):
            yield shard(part for _, part in parts)

    return run


def _mixed(parts: DataFrame):
    """Row-weighted mean of the shards' weights, by exact sums; one row per weight arrives here."""
    # Behind the weights stand the loss and the counts.
    listed = F.concat(F.transform("w", lambda x: x * F.col("n")), F.array("loss", "n", "held", "hits"))
    total = {r["i"]: r["x"] for r in exact_sum(parts.select(F.posexplode(listed).alias("i", "x")), ["i"], "x", "x").collect()}
    *flat, loss, n, held, hits = (total[i] for i in range(len(total)))
    return np.array(flat) / max(n, 1.0), loss / max(n, 1.0), hits / held if held else None


@dataclass(frozen=True)
class OnlineLinear:
    name: str
    rule: Rule = field(repr=False)
    max_rounds: int = 1000
    tolerance: float | None = 1e-3
    patience: int = 5
    validation_share: float = 0.0
    seed: int = 0
    key: str = "row_idx"

    def fit(self, encoded: DataFrame, encoding):
        counts = class_counts(encoded)
        if len(counts) == 1:
            return DummyModel("most_frequent", float(next(iter(counts))), 0, "")
        digest = seeded_key(self.seed, self.key)
        draw = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(16**8)
        # Rows are spread by digest, so each shard sees a random mix; the copy is read back every round.
        shards = ceil(sum(counts.values()) / SHARD_ROWS)
        train = stage(
            encoded.select("hot", "numbers", "label", digest.alias("digest"))
            .withColumn("held_out", draw < self.validation_share)
            .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
            .repartition(shards, "shard")
            .sortWithinPartitions("shard", "digest")
            .drop("digest"),
            "online",
        )
        flat = Weights.zero(encoding.width_hot, encoding.width_numbers).flat()
        best_flat, best, stale, rounds = flat, None, 0, 0
        per_shard = sum(counts.values()) / shards
        for rounds in range(1, self.max_rounds + 1):
            start = flat
            parts = train.mapInPandas(
                _one_round(start, encoding.width_hot, self.rule, per_shard * (rounds - 1)), _PART_SCHEMA
            )
            flat, loss, accuracy = _mixed(parts)
            if accuracy is None:
                value, judged = -loss, flat
            elif rounds == 1:
                continue  # the zero weights were judged, not a trained model
            else:
                value, judged = accuracy, start
            gain = (self.tolerance or 0.0) if best is not None else 0.0
            stale = 0 if best is None or value > best + gain else stale + 1
            if best is None or value > best:
                best, best_flat = value, judged
            if self.tolerance is not None and stale >= self.patience:
                break
        chosen = best_flat if self.validation_share and best is not None else flat
        return self._model(chosen, encoding.width_hot, rounds)

    @staticmethod
    def _model(flat: np.ndarray, width_hot: int, rounds: int) -> LinearModel:
        w = Weights.of(flat, width_hot)
        return LinearModel(w.slots.tolist(), w.numbers.tolist(), w.bias, rounds)


def perceptron(
    penalty: str = "l1", alpha: float = 1e-4, eta: float = 1.0, max_rounds: int = 1000,
    tolerance: float | None = 1e-3, patience: int = 5, validation_share: float = 0.1, seed: int = 0,
) -> OnlineLinear:
    return OnlineLinear(
        "perceptron", perceptron_rule(alpha, penalty, eta), max_rounds, tolerance, patience, validation_share, seed
    )


def passive_aggressive(c: float = 1.0, max_rounds: int = 1000, tolerance: float | None = 1e-3, seed: int = 0) -> OnlineLinear:
    return OnlineLinear("passive_aggressive", passive_aggressive_rule(c), max_rounds, tolerance, seed=seed)


def linear_svm(
    alpha: float = 1e-4, l1_ratio: float = 0.15, max_rounds: int = 1000, tolerance: float | None = 1e-3, seed: int = 0
) -> OnlineLinear:
    return OnlineLinear("linear_svm", hinge_rule(alpha, l1_ratio), max_rounds, tolerance, seed=seed)
