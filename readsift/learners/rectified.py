"""A network of one rectified hidden layer, trained by Adam with an L2 penalty and stopped on held-out loss.

Rows are dealt to fixed shards in a seeded order, as for the linear learners. Each round every shard runs its
mini-batches from the shared weights and moments and returns its own; Spark averages them by exact sums, a slice of
the vector at a time, so neither partitions nor the order of tasks change a model. One shard, of up to 50,000 rows, is
plain mini-batch Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil, fsum
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readsift.learners.online import SHARD_ROWS
from readsift.learners.simple import DummyModel, class_counts
from readsift.operators.rank import seeded_key
from readsift.session import stage

# Decay of the two moments and the guard of the step, as Adam is usually run.
_DECAY_1, _DECAY_2, _GUARD = 0.9, 0.999, 1e-8
#: Numbers of a slice: a task that mixes one holds so many of every shard.
SLICE = 2048


@dataclass(frozen=True)
class Shape:
    """Weights in one vector: a row per slot (the last, for unknown values, stays zero) and per number, then the hidden
    biases, the output weights and the output bias."""

    slots: int
    numbers: int
    hidden: int

    @property
    def size(self) -> int:
        return (self.slots + 1 + self.numbers + 2) * self.hidden + 1

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of slot rows, number rows, hidden biases, output weights and output bias."""
        cuts = np.cumsum([(self.slots + 1) * self.hidden, self.numbers * self.hidden, self.hidden, self.hidden])
        table, numbers, bias, out, last = np.split(flat, cuts)
        return table.reshape(-1, self.hidden), numbers.reshape(-1, self.hidden), bias, out, last

    def start(self, seed: int) -> np.ndarray:
        """Even draws within the square root of 6 over the layer's inputs and outputs; unknown values weigh nothing."""
        draw, flat = np.random.default_rng(seed), np.zeros(self.size)
        table, numbers, bias, out, last = self.parts(flat)
        for part, inputs, outputs in ((table, self.slots + self.numbers, self.hidden), (numbers, self.slots + self.numbers, self.hidden),
                                      (bias, self.slots + self.numbers, self.hidden), (out, self.hidden, 1), (last, self.hidden, 1)):
            reach = np.sqrt(6.0 / max(inputs + outputs, 1))
            part[...] = draw.uniform(-reach, reach, part.shape)
        table[-1] = 0.0
        return flat

    def margin(self, flat: np.ndarray, hot: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        table, weights, bias, out, last = self.parts(flat)
        return np.maximum(table[hot].sum(axis=1) + numbers @ weights + bias, 0.0) @ out + last

    def loss_and_slope(self, flat, hot, numbers, label, penalty: float) -> tuple[float, np.ndarray]:
        """Mean log loss of a batch plus half the penalty times the squared weights (not biases) over its rows."""
        table, weights, bias, out, last = self.parts(flat)
        # How often each row has each of the slots that occur: sums over slots, both ways, are products with it.
        slots, at = np.unique(hot, return_inverse=True)
        has = np.bincount((at.reshape(hot.shape) + len(slots) * np.arange(len(hot))[:, None]).ravel(), minlength=len(hot) * len(slots))
        has = has.reshape(len(hot), len(slots)).astype(float)
        before = has @ table[slots] + numbers @ weights + bias
        hidden, n = np.maximum(before, 0.0), len(label)
        margin = hidden @ out + last
        loss = float((np.logaddexp(0.0, margin) - label * margin).mean())
        slope = np.zeros_like(flat)
        to_table, to_weights, to_bias, to_out, to_last = self.parts(slope)
        off = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label) / n
        to_out += hidden.T @ off
        to_last += off.sum()
        back = np.outer(off, out) * (before > 0)
        to_bias += back.sum(axis=0)
        to_weights += numbers.T @ back
        to_table[slots] = has.T @ back
        for own, to in ((table, to_table), (weights, to_weights), (out, to_out)):
            loss += 0.5 * penalty * float((own * own).sum()) / n
            to += penalty * own / n
        to_table[-1] = 0.0
        return loss, slope


def adam_step(flat, first, second, slope, step: int, rate: float) -> None:
    """One step in place; ``step`` counts from 1."""
    first += (1 - _DECAY_1) * (slope - first)
    second += (1 - _DECAY_2) * (slope * slope - second)
    size = rate * np.sqrt(1 - _DECAY_2**step) / (1 - _DECAY_1**step)
    flat -= size * first / (np.sqrt(second) + _GUARD)


_PART_SCHEMA = "slice int, w binary, n double, held double, held_loss double"


@dataclass(frozen=True)
class RectifiedModel:
    shape: Shape
    flat: np.ndarray
    rounds: int
    held_loss: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        shape, weights = self.shape, df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("double")
        def probability(hot: pd.Series, numbers: pd.Series) -> pd.Series:
            margin = shape.margin(weights.value, *_arrays(hot, numbers))
            return pd.Series(1 / (1 + np.exp(-np.clip(margin, -500, 500))))

        return df.withColumn("p1", probability("hot", "numbers")).withColumns(
            {"score": F.col("p1"), "prediction": (F.col("p1") > 0.5).cast("int")}
        )


def _arrays(hot: pd.Series, numbers: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.array(hot.tolist(), np.int64).reshape(len(hot), -1), np.array(numbers.tolist(), float).reshape(len(hot), -1)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _round(state: np.ndarray, steps: int, shape: Shape, settings: "RectifiedNetwork"):
    """Task of one round: judge the shared weights on held-out rows, train each shard's own on the rest."""

    def shard(pieces: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        flat, first, second = state.reshape(3, -1).copy()
        rows, held, held_loss, step = 0, 0, 0.0, steps
        for piece in pieces:
            hot, numbers = _matrix(piece["hot"], np.int64), _matrix(piece["numbers"], float)
            label, out = piece["label"].to_numpy(zero_copy_only=False).astype(float), piece["held_out"].to_numpy(zero_copy_only=False)
            if out.any():
                margin = shape.margin(state[: shape.size], hot[out], numbers[out])
                held += int(out.sum())
                held_loss += float((np.logaddexp(0.0, margin) - label[out] * margin).sum())
                hot, numbers, label = hot[~out], numbers[~out], label[~out]
            for at in range(0, len(label), settings.batch):
                cut = slice(at, at + settings.batch)
                _, slope = shape.loss_and_slope(flat, hot[cut], numbers[cut], label[cut], settings.penalty)
                step += 1
                adam_step(flat, first, second, slope, step, settings.rate)
            rows += len(label)
        made = np.concatenate([flat, first, second])
        slices = [made[at : at + SLICE].tobytes() for at in range(0, len(made), SLICE)]
        k = len(slices)
        return pa.RecordBatch.from_pydict({
            "slice": pa.array(range(k), pa.int32()), "w": slices, "n": [float(rows)] * k, "held": [float(held)] * k, "held_loss": [held_loss] * k,
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(_pieces(batches), key=itemgetter(0)):
            yield shard(part for _, part in parts)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one shard each, in order; rows are sorted by shard."""
    for batch in batches:
        number = batch["shard"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for first, end in zip(edges[:-1], edges[1:]):
            if end > first:
                yield int(number[first]), batch.slice(first, end - first)


def _mix(parts: pd.DataFrame) -> pd.DataFrame:
    """Sums over all shards of one slice, weighted by rows. They are exact before their rounding, so order changes nothing."""
    rows = parts["n"].to_numpy()
    each = np.stack([np.frombuffer(w, float) for w in parts["w"]]) * rows[:, None]
    # What is not finite in a shard is unknown in the sum.
    total = [fsum(column) for column in np.where(np.isfinite(each).all(axis=0), each, np.nan).T.tolist()]
    loss = parts["held_loss"].to_numpy()
    return pd.DataFrame({
        "slice": parts["slice"].iloc[:1].to_numpy(), "w": [np.array(total).tobytes()], "n": [rows.sum()], "held": [parts["held"].sum()],
        "held_loss": [fsum(loss) if np.isfinite(loss).all() else np.nan],
    })


@dataclass(frozen=True)
class RectifiedNetwork:
    """``penalty`` is the L2 weight, ``rate`` Adam's step; training stops when the held-out loss has not fallen by
    ``tolerance`` for ``patience`` rounds, and the best weights are kept. Without held-out rows it runs all rounds."""

    hidden: int = 100
    penalty: float = 1e-4
    rate: float = 1e-3
    batch: int = 200
    max_rounds: int = 200
    patience: int = 10
    tolerance: float = 1e-4
    validation_share: float = 0.1
    seed: int = 0
    key: str = "row_idx"
    name: str = "rectified_network"

    def fit(self, encoded: DataFrame, encoding):
        counts = class_counts(encoded)
        if len(counts) == 1:
            return DummyModel("most_frequent", float(next(iter(counts))), 0, "")
        shape = Shape(encoding.width_hot, encoding.width_numbers, self.hidden)
        shards = ceil(sum(counts.values()) / SHARD_ROWS)
        draw = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(16**8)
        train = stage(
            encoded.select("hot", "numbers", "label", seeded_key(self.seed, self.key).alias("digest"))
            .withColumn("held_out", draw < self.validation_share)
            .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
            .repartition(shards, "shard").sortWithinPartitions("shard", "digest").drop("digest"),
            "network",
        )
        per_round = ceil(sum(counts.values()) * (1 - self.validation_share) / shards / self.batch)
        state = np.concatenate([shape.start(self.seed), np.zeros(2 * shape.size)])
        best, best_loss, stale, rounds = state, None, 0, 0
        for rounds in range(1, self.max_rounds + 2):
            mixed, held_loss = self._mixed(train.mapInArrow(_round(state, (rounds - 1) * per_round, shape, self), _PART_SCHEMA))
            # A round judges the weights that it starts from, so the last one only judges.
            if held_loss is not None and rounds > 1:
                stale = 0 if best_loss is None or held_loss < best_loss - self.tolerance else stale + 1
                if best_loss is None or held_loss < best_loss:
                    best, best_loss = state, held_loss
            if stale >= self.patience or rounds > self.max_rounds:
                break
            state = mixed
        chosen = best if best_loss is not None else state
        return RectifiedModel(shape, chosen[: shape.size].copy(), rounds - 1, best_loss)

    @staticmethod
    def _mixed(parts: DataFrame) -> tuple[np.ndarray, float | None]:
        """Row-weighted mean of the shards' weights and moments, and the mean held-out loss."""
        found = parts.groupBy("slice").applyInPandas(_mix, _PART_SCHEMA).toPandas().sort_values("slice")
        _, _, n, held, loss = found.iloc[0]
        total = np.concatenate([np.frombuffer(w, float) for w in found["w"]])
        return total / max(n, 1.0), loss / held if held else None
