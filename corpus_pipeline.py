"""A corpus pipeline: quality, near copies, repeated passages, benchmark passages, packing.

Every stage takes the documents its predecessor kept and returns documents with the same columns; the last
returns the pieces of the packed sequences. Between stages the rows are written and read again: a result must be
written before the next stage is called, which deletes the copies that the one before needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from readsift.llm import decontaminate, jaccard, packing, quality, substrings
from readsift.llm.common import table
from readsift.llm.queries import prepared
from readsift.session import release, stage, staged

# Copies that the stage called last has made for itself.
_OWN: set[str] = set()


def _owning(function: Callable) -> Callable:
    """Take away what the stage before has staged for itself: its result is written by now, which is what ``docs`` reads."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, kept=set(staged()) - _OWN)
        before = set(staged())
        result = function(spark, docs, sf_dir)
        _OWN.clear()
        _OWN.update(set(staged()) - before)
        return result

    return run_stage


@_owning
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3. The model learns from the labels of the training folds."""
    prepared(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return quality.score(packed, model, threshold=0.3).where("predicted = 1").select("_row.*")


@_owning
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that links of 80 per cent of 5-word shingles connect."""
    return jaccard.keep_one_each(prepared(spark, docs))


@_owning
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return substrings.without_repeats(prepared(spark, docs))


@_owning
def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than one word in 20 inside a benchmark passage."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.clean(prepared(spark, docs), items)


@_owning
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack_documents(prepared(spark, docs), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", keep_clean),
    ("best-fit packing", pack),
]
#: The model and the tokens cannot be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
