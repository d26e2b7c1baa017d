"""Quality classifier learnt from positives and unlabelled text.

Only texts trusted to be good are labelled; the rest of the web is a mix. The non-negative PU risk
``p * E_P[loss(g, +1)] + max(0, E_U[loss(g, -1)] - p * E_P[loss(g, -1)])`` is an unbiased estimate of the
risk with both labels, kept from falling below zero (where it would only over-fit the positives). p is the class
prior, estimated from the labelled training rows. The model is linear over thresholds of surface features, so
scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from readsift.llm.common import if_small
from readsift.session import stage

#: Rows of each kind that the fit reads, about: a hash of doc_id draws them. Raising it only costs driver memory.
MAX_TRAIN = 20_000
FOLDS = 5
_CUTS = 9  # thresholds per feature, at even quantiles of the unlabelled sample
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PROSE = np.zeros(256, bool)  # marks that running prose uses
_PROSE[list(b".,;:!?'\"()-")] = True
_OTHER = ~(_LETTER | _DIGIT | _SPACE | _PROSE)

FEATURES = (
    "log_words", "upper_share", "digit_share", "space_share", "prose_mark_share", "other_mark_share", "word_length",
    "repeated_neighbours", "distinct_words", "shouted_marks", "repeated_lines", "words_per_line", "stops_per_word",
)


def features(text: str | None) -> list[float]:
    """Surface features of a whole text, in the order of ``FEATURES``; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = max(len(raw), 1), raw.split(), raw.split(b"\n")
    m = max(len(words), 1)
    return [
        np.log1p(len(words)), counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_SPACE].sum() / n,
        counts[_PROSE].sum() / n, counts[_OTHER].sum() / n, len(raw) / m,
        sum(map(eq, words, words[1:])) / m, len(set(words)) / m ** 0.9, counts[33] / m,
        1 - len(set(lines)) / len(lines), m / len(lines), counts[46] / m,
    ]


@dataclass(frozen=True)
class Model:
    """``cuts``: thresholds per feature; ``weights``: one per threshold, then the bias."""

    cuts: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        above = x[:, :, None] > self.cuts[None, :, :]
        return np.concatenate([above.reshape(len(x), -1), np.ones((len(x), 1))], axis=1, dtype=np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.5, decay: float = 2e-4) -> Model:
    """Minimise the non-negative PU risk with the logistic loss, and a little weight decay, by full gradients.

    Where the estimate of the negatives' risk falls below zero, the risk counts it as zero, and so does its slope.
    """
    shares = np.linspace(0, 1, _CUTS + 2)[1:-1]
    spread = np.concatenate([np.quantile(unlabelled, shares, axis=0), np.quantile(unlabelled, [0.01, 0.03, 0.97, 0.99], axis=0)])
    model = Model(np.sort(spread, axis=0).T, np.zeros(spread.size + 1))
    p, u = model.design(positive), model.design(unlabelled)
    weights, speed = model.weights.copy(), np.zeros(spread.size + 1)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(steps):
        zp, zu = p @ weights, u @ weights
        # The gradient of log(1 + exp(-z)) is squash(z) - 1, that of log(1 + exp(z)) is squash(z).
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        for_negative = u.T @ squash(zu) / len(u) - prior * (p.T @ squash(zp)) / len(p)
        slope = prior * (p.T @ (squash(zp) - 1)) / len(p) + (for_negative if as_negative > 0 else 0.0)
        speed = 0.9 * speed - rate * (slope + decay * weights)
        weights = weights + speed
    return Model(model.cuts, weights)


def held_out(doc_id: Column) -> Column:
    """The fold from which no label is learnt; null ids are outside it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _drawn(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows, drawn by a hash of doc_id; all of them if there are no more."""
    share = min(1.0, rows / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _matrix(df: DataFrame) -> np.ndarray:
    """Features of a bounded sample, on the driver."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(t) for t in batch["text"]]})

    rows = df.select("text").mapInPandas(made, "x array<double>").toPandas()["x"]
    return np.asarray(rows.tolist(), np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Fit on the training folds. ``labels`` has doc_id and quality; ids labelled both ways say nothing. Without a
    trusted positive there is no model."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("_low"), F.max("quality").alias("quality")
    )
    known = stage(known.where((F.col("_low") == F.col("quality")) & ~held_out(F.col("doc_id"))).drop("_low"), "labels")
    prior = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    trusted = _drawn(known.where("quality = 1").select("doc_id"), max_train)
    if prior is None or trusted.isEmpty():
        return None
    fold = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    positive = _matrix(fold.join(if_small(stage(trusted, "trusted"), 2 * max_train), "doc_id", "left_semi"))
    unlabelled = _matrix(_drawn(fold, max_train))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, float(prior))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on). Null and empty texts are scored like any
    other, from features of zero; without a model every score is 0.5. Columns called like the two are replaced;
    every row keeps its row, and an empty table gives none."""
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.asarray([features(t if isinstance(t, str) else None) for t in batch["text"]]).reshape(-1, len(FEATURES))
            values = model.score(x).astype(np.float64) if model is not None else np.full(len(x), 0.5)
            yield batch.assign(score=values, predicted=(values >= threshold).astype(np.int32))

    return kept.mapInPandas(scored, schema)
