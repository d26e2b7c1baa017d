"""Importance resampling towards a target: documents drawn in proportion to how likely the target makes their words.

Both sides are told by hashed bags of word runs. The log ratio of the target's and the corpus's share of a bucket, in
thousandths, is the gain of a feature there; gains are an array of fixed size that every task holds, so a document's
weight is a sum over its features without a join. Gumbel noise from a digest of its id turns the highest scores into
a draw without replacement.

The cutoff needs no sort of all rows. A quantile sketch of the scores gives a bracket round it; exact counts above
and inside say whether the bracket holds the cutoff, else it is widened; only the rows inside are sorted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from readsift.operators.rank import row_index
from readsift.session import stage

#: Bytes of a text that are in work at once.
SLICE = 1 << 20
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_FOLDED = bytes(32 if _SEPARATOR.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SKETCH = 2048  # entries of the quantile sketch: ranks are off by about a thousandth


def word_lists(text: str | None, piece: int = SLICE) -> Iterator[list[bytes]]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, in lists of bounded size; none of null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        # A piece ends between words, so that it is longer only by the rest of a word.
        stop = _SEPARATOR.search(raw, at + piece)
        end = stop.start() if stop else len(raw)
        yield raw[at:end].translate(_FOLDED).split()
        at = end


def feature_lists(text: str | None, max_run: int = 1, piece: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Per piece of a text its number of words and all runs of 1 to ``max_run`` words that end in it."""
    tail: list[bytes] = []
    for words in word_lists(text, piece):
        found = list(words)
        near = tail + words
        for run in range(2, max_run + 1):
            start = max(len(tail) - run + 1, 0)
            found += [b" ".join(near[i : i + run]) for i in range(start, len(near) - run + 1)]
        yield len(words), found
        tail = near[len(near) - max_run + 1 :] if max_run > 1 else []


def _bucket(features: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def bucket_counts(df: DataFrame, buckets: int, max_run: int = 1, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts per bucket. A task adds up its rows; one array of it is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["t"]:
                for _, features in feature_lists(text, max_run):
                    totals += np.bincount(_bucket(features, buckets), minlength=buckets)
        full = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": full, "n": totals[full]})

    parts = df.select(F.col(text_col).alias("t")).mapInPandas(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from the two tables of :func:`bucket_counts`: ``buckets`` numbers, whatever the corpus.

    A gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).
    """
    spark = corpus.sparkSession
    s, t = corpus.select("bucket", F.col("n").alias("own")), target.select("bucket", F.col("n").alias("wanted"))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    own, wanted = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("own", "wanted"))
    all_own, all_wanted = (int(side.agg(F.sum("n")).first()[0] or 0) for side in (corpus, target))
    ratio = (wanted + 1) * F.lit(float(all_own + buckets)) / ((own + 1) * F.lit(float(all_wanted + buckets)))
    gains = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").toPandas()["gain"]
    return gains.to_numpy(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, max_run: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight, the sum of its features' gains (0 without any)."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n, m, weight = 0, 0, 0
            for words, features in feature_lists(text, max_run):
                n, m = n + words, m + len(features)
                weight += int(gains[_bucket(features, len(gains))].sum())
            rows.append((n, m, weight))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    made = docs.withColumn("_w", weighed(text_col))
    return made.withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "n_features", "weight")}).drop("_w")


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256(``seed:id``); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Bracket:
    """Scores from ``low`` to ``high`` hold the cutoff: ``above`` rows score higher, fewer than are drawn."""

    low: int
    high: int
    above: int
    inside: int


def find_bracket(scored: DataFrame, wanted: int, margin: float = 0.004, sketch: int = _SKETCH) -> Bracket:
    """A bracket round the ``wanted``-th highest score of staged rows, 1 <= wanted <= rows.

    ``margin`` is a share of the rows on each side of the sketch's answer. Exact counts accept the bracket or widen
    it fourfold, at last to all scores, so the sketch only decides how many rows are sorted.
    """
    found = scored.agg(F.kll_sketch_agg_bigint("score", F.lit(sketch)).alias("k"), F.count(F.lit(1)).alias("n"), F.min("score"), F.max("score"))
    k, n, least, most = found.first()
    spark = scored.sparkSession
    while True:
        cut = 1 - wanted / n
        at = [max(cut - margin, 0.0), min(cut + margin, 1.0)]
        low, high = spark.createDataFrame([(k,)], "k binary").select(
            F.kll_sketch_get_quantile_bigint("k", F.array(*map(F.lit, at)))
        ).first()[0]
        low, high = (least if at[0] == 0 else low), (most if at[1] == 1 else high)
        count = lambda rows: F.count(F.when(rows, 1))
        above, inside = scored.agg(count(F.col("score") > high), count(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return Bracket(low, high, above, inside)
        margin = max(4 * margin, 0.001)


def rank_drawn(scored: DataFrame, wanted: int, order: list[str], margin: float = 0.004, sketch: int = _SKETCH) -> DataFrame:
    """Staged rows with ``rank``: 1.. for the ``wanted`` highest scores in falling order, ties by ``order``; else null.

    The rows above the bracket are drawn whatever the cutoff and are sorted only to be numbered; the bracket is sorted
    to find the cutoff; the rows below it are never sorted.
    """
    none = F.lit(None).cast("bigint").alias("rank")
    wanted = min(wanted, scored.where("eligible").count())
    if wanted <= 0:
        return scored.select("*", none)
    bracket = find_bracket(scored.where("eligible"), wanted, margin, sketch)
    columns, falling = scored.columns, scored.withColumn("_falling", -F.col("score"))

    def numbered(rows: DataFrame, before: int) -> DataFrame:
        at = row_index(rows, ["_falling", *order], "_at", from_scan=True)
        rank = F.col("_at") + before + 1
        return at.select(*columns, F.when(rank <= wanted, rank).alias("rank"))

    above = numbered(falling.where(F.col("eligible") & (F.col("score") > bracket.high)), 0)
    inside = numbered(falling.where(F.col("eligible") & F.col("score").between(bracket.low, bracket.high)), bracket.above)
    rest = scored.where(~F.col("eligible") | (F.col("score") < bracket.low)).select(*columns, none)
    return above.unionByName(inside).unionByName(rest)


def importance_ranks(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), buckets: int = 10_000, max_run: int = 1,
    min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, eligible, rank) of every document, ``text_hash`` of its text.

    Of the documents with ``min_words`` words the share ``share[0]/share[1]`` (rounded down) of highest scores is
    drawn; ``rank`` numbers them and is null for the others. Score is weight plus noise. Ties go to the smaller id (null
    first), then to the smaller hash; rows equal in all of it are interchangeable.

    A null or empty text has no features and weight 0. An empty target makes rare buckets gain; an empty corpus gives
    no rows. Repeated rows count and are drawn each for itself. Other columns of ``docs`` are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gains = bucket_gains(
        stage(bucket_counts(own, buckets, max_run), "corpus-buckets"),
        stage(bucket_counts(target.select(F.col(text_col).alias("text")), buckets, max_run), "target-buckets"), buckets,
    )
    scored = weigh(own, gains, max_run).select(
        "id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed, F.col("id"))).alias("score"),
        (F.col("n_words") >= min_words).alias("eligible"), F.xxhash64("text").alias("text_hash"),
    )
    scored = stage(scored, "importance-scores")
    wanted = scored.where("eligible").count() * share[0] // share[1]
    return rank_drawn(scored, wanted, ["id", "text_hash"])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents themselves, with all their columns. Rows equal in id and text come together or not at all."""
    drawn = importance_ranks(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    keys = stage(drawn.select(F.col("id").alias("_id"), F.col("text_hash").alias("_text")).distinct(), "drawn")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_text"))
    return docs.join(keys, same, "left_semi")
