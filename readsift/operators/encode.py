"""One-hot, standardised and passed-through features as pyspark.ml stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from readsift.config import FeatureSpec
from readsift.operators.exact import Total, binned_sums
from readsift.operators.profile import moments, vocabulary
from readsift.operators.rank import row_index
from readsift.plans.features import require
from readsift.session import stage

#: Values that are looked up in a task's memory, of the columns with the fewest. The other columns, of any number of
#: values, find their slots by a join with the vocabulary table; slots are the same either way.
LOOKED_UP = 50_000
#: Sets of rows that are described in one pass.
TOGETHER = 10


def one_hot_long(df: DataFrame, columns, key: str) -> DataFrame:
    """Active one-hot slots, one row each, by a join with the vocabulary.

    Needs no vocabulary on the driver; unknown values simply have no row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    active = df.select(key, F.explode(pairs).alias("p")).select(key, "p.column", "p.value")
    return active.join(vocabulary(df, columns), ["column", "value"]).select(key, "column", "slot")


def standardised(df: DataFrame, columns, fitted_on: DataFrame | None = None) -> DataFrame:
    """Replace columns by (x - mean) / population deviation; deviation 0 counts as 1."""
    stats = {row["column"]: row for row in moments(fitted_on if fitted_on is not None else df, columns).collect()}
    return df.withColumns(
        {c: (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"] or 1.0) for c in columns}
    )


def _number(column: str) -> str:
    """The column as a number. No learner has an answer for a missing one, so it fails the job by name."""
    return f"COALESCE(CAST(`{column}` AS DOUBLE), CAST(raise_error('column {column} holds NULL') AS DOUBLE))"


def raw_numbers(spec: FeatureSpec) -> Column:
    """The numeric and passed-through columns as they are, in the order of ``numbers``."""
    return F.array(*[F.expr(_number(c)) for c in (*spec.numerical, *spec.passthrough)]).cast("array<double>")


def _token(position: int) -> str:
    """Prefix that keeps equal values of different columns apart."""
    return f"{position}="


@dataclass(frozen=True)
class Categories:
    """Vocabulary of the categorical columns: how many values each has, the sorted values of the columns that are looked
    up, and a staged table (column, value, position) of the others. A value's slot is its column's first slot plus its
    position among the column's sorted values."""

    columns: tuple[str, ...]
    sizes: tuple[int, ...]
    listed: dict[str, tuple[str, ...]]
    table: DataFrame | None = None

    @property
    def width(self) -> int:
        return sum(self.sizes)

    def first_slot(self, column: str) -> int:
        return sum(self.sizes[: self.columns.index(column)])

    def blocks(self) -> list[tuple[int, tuple[str, ...]]]:
        """(first slot, columns) of neighbouring columns that are looked up together, and of each joined one."""
        runs = groupby(self.columns, key=lambda c: None if c in self.listed else c)
        return [(self.first_slot(run[0]), run) for _, group in runs for run in [tuple(group)]]


@dataclass(frozen=True)
class Encoding:
    """Fitted encoding; ``transform`` adds three views of the same features.

    ``features``: sparse vector, one-hot block, then numerics, then the rest;
    ``hot``: active slots in rising order, padded with ``width_hot``, one per
    categorical column;
    ``numbers``: standardised numerics and passed-through columns.
    """

    spec: FeatureSpec
    categories: Categories
    stats: dict[str, tuple[float, float]]
    stages: PipelineModel

    @property
    def labels(self) -> tuple[tuple[str, ...] | None, ...]:
        """Sorted values per categorical column; None for a column whose values stay in the table."""
        return tuple(self.categories.listed.get(c) for c in self.spec.categorical)

    @property
    def width_hot(self) -> int:
        return self.categories.width

    @property
    def width_numbers(self) -> int:
        return len(self.spec.numerical) + len(self.spec.passthrough)

    @property
    def width(self) -> int:
        return self.width_hot + self.width_numbers

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.spec.features)
        known, made, active = self.categories, df, []
        for k, (first, run) in enumerate(known.blocks()):
            if run[0] in known.listed:
                if any(known.listed[c] for c in run):
                    active.append(F.transform(F.unwrap_udt(f"_onehot_{k}")["indices"], lambda s: s + first))  # called at once
                continue
            (column,) = run
            own = known.table.where(F.col("column") == column).select(
                F.col("value").alias("_value"), F.col("position").cast("int").alias(f"_position_{k}")
            )
            made = made.join(own, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")
            active.append(F.array_compact(F.array(F.col(f"_position_{k}") + first)))
        hot = F.concat(*active) if active else F.array().cast("array<int>")
        missing = len(self.spec.categorical) - F.size("_hot")
        made = self.stages.transform(made).withColumn("_hot", hot)
        return made.withColumn("hot", F.concat("_hot", F.array_repeat(F.lit(self.width_hot), missing))).drop(
            "_numbers", "_hot", *[f"_{kind}_{k}" for k in range(len(known.blocks())) for kind in ("tokens", "onehot", "position", "place")]
        )


def nonzero_entries(encoded: DataFrame, key: str, vector: str = "features") -> DataFrame:
    """(key, position, value) of the entries of a vector column that are not zero, from its own arrays of indices and
    values; a vector is never made dense."""
    v = F.unwrap_udt(vector)
    pair = lambda i, x: F.struct(i.cast("int").alias("position"), x.alias("value"))
    sparse = F.zip_with(v["indices"], v["values"], pair)
    dense = F.transform(v["values"], lambda x, i: pair(i, x))
    entries = F.when(v["type"] == 0, sparse).otherwise(dense)
    return encoded.select(key, F.explode(F.filter(entries, lambda e: e["value"] != 0)).alias("e")).select(key, "e.*")


def _numeric(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, NumericType)}


def categories(df: DataFrame, spec: FeatureSpec, looked_up: int = LOOKED_UP) -> Categories:
    """Sorted values of each categorical column; find them once for many fits.

    At most ``looked_up`` values come to the driver, however many there are. Numeric columns sort by number.
    """
    columns = tuple(spec.categorical)
    if not columns:
        return Categories((), (), {})
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    numeric = _numeric(df)
    found, table = distinct.limit(looked_up + 1).collect(), None
    sizes = dict.fromkeys(columns, 0)
    if len(found) <= looked_up:
        small = set(columns)
        for row in found:
            sizes[row["column"]] += 1
    else:
        distinct = stage(distinct, "values")
        sizes |= {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
        small, room = set(), looked_up
        for c in sorted(columns, key=sizes.get):
            room -= sizes[c]
            if room >= 0:
                small.add(c)
        found = distinct.where(F.col("column").isin(*small)).collect()
        number = F.when(F.col("column").isin(*numeric), F.expr("try_cast(value AS DOUBLE)"))
        rest = distinct.where(~F.col("column").isin(*small)).withColumn("number", number)
        ranked = stage(row_index(rest, ["column", "number", "value"], "at", from_scan=True), "vocabulary")
        first = ranked.groupBy("column").agg(F.min("at").alias("first"))
        table = stage(ranked.join(F.broadcast(first), "column").select("column", "value", (F.col("at") - F.col("first")).alias("position")), "vocabulary")
    by_column: dict[str, list[str]] = {c: [] for c in columns if c in small}
    for row in found:
        by_column[row["column"]].append(row["value"])
    listed = {c: tuple(sorted(v, key=float if c in numeric else str)) for c, v in by_column.items()}
    return Categories(columns, tuple(sizes[c] for c in columns), listed, table)


def known_categories(vocabulary_from: DataFrame | Categories | None, spec: FeatureSpec) -> Categories | None:
    """The categories of a frame; found ones, and None, pass through."""
    return categories(vocabulary_from, spec) if isinstance(vocabulary_from, DataFrame) else vocabulary_from


def fit_encoding(
    train: DataFrame, spec: FeatureSpec, vocabulary_from: DataFrame | Categories | None = None
) -> Encoding:
    """Learn categories and moments.

    Categories come from ``vocabulary_from`` (say, all rows, or categories found
    before) when given, else from the training rows; a value outside them encodes
    as all zeros.
    """
    require(train, spec.features)
    known = known_categories(vocabulary_from if vocabulary_from is not None else train, spec)
    stats = {
        row["column"]: (row["mean"] or 0.0, row["std"] or 1.0) for row in moments(train, spec.numerical).collect()
    } if spec.numerical else {}
    return _encoding(train.sparkSession, spec, known, stats)


def fit_encodings(
    df: DataFrame, members: Sequence[Column], spec: FeatureSpec, vocabulary_from: DataFrame | Categories | None = None,
    looked_up: int = LOOKED_UP,
) -> list[Encoding]:
    """:func:`fit_encoding` of the rows of ``df`` that each condition of ``members`` holds for.

    Rows are summed, exactly, and their values listed by the set of conditions that they meet, so ``TOGETHER`` members
    cost one pass over ``df`` and not one each. Folds of one column make as many sets as folds.
    """
    require(df, spec.features)
    shared, made = known_categories(vocabulary_from, spec), []
    for first in range(0, len(members), TOGETHER):
        some = members[first : first + TOGETHER]
        met = sum((F.when(m, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(some)), F.lit(0))
        marked = df.select(*spec.features, met.alias("_met")).where("_met > 0")
        sums = [{c: Total() for c in spec.numerical} for _ in some]
        for row in binned_sums(marked, spec.numerical, ["_met"]).collect() if spec.numerical else []:
            for i in range(len(some)):
                if row["_met"] >> i & 1:
                    sums[i][row["column"]].add(row)
        known = [shared] * len(some) if shared is not None else _categories_of(marked, df, some, spec, looked_up)
        for found, total in zip(known, sums):
            made.append(_encoding(df.sparkSession, spec, found, {c: (t.mean or 0.0, t.deviation or 1.0) for c, t in total.items()}))
    return made


def _categories_of(marked: DataFrame, df: DataFrame, members: Sequence[Column], spec: FeatureSpec, looked_up: int) -> list[Categories]:
    """Categories of each member's rows; from one list of values if the driver may hold it, else member by member."""
    columns = tuple(spec.categorical)
    if not columns:
        return [Categories((), (), {})] * len(members)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = marked.select("_met", F.explode(pairs).alias("p")).select("_met", "p.*").where("value IS NOT NULL").distinct()
    found = values.limit(looked_up + 1).collect()
    if len(found) > looked_up:
        return [categories(df.where(m), spec, looked_up) for m in members]
    numeric, made = _numeric(df), []
    for i in range(len(members)):
        by_column: dict[str, set[str]] = {c: set() for c in columns}
        for row in found:
            if row["_met"] >> i & 1:
                by_column[row["column"]].add(row["value"])
        listed = {c: tuple(sorted(v, key=float if c in numeric else str)) for c, v in by_column.items()}
        made.append(Categories(columns, tuple(len(by_column[c]) for c in columns), listed))
    return made


def _encoding(spark: SparkSession, spec: FeatureSpec, known: Categories, stats: dict[str, tuple[float, float]]) -> Encoding:
    scaled = [f"({_number(c)} - ({stats[c][0]!r}D)) / {stats[c][1]!r}D" for c in spec.numerical]
    passed = [_number(c) for c in spec.passthrough]
    columns, encoders, assembled = [f"CAST(ARRAY({', '.join(scaled + passed)}) AS ARRAY<DOUBLE>) AS numbers"], [], []
    for k, (_, run) in enumerate(known.blocks()):
        if run[0] not in known.listed:
            # A value outside the vocabulary takes the last place, which is dropped.
            size = known.sizes[known.columns.index(run[0])]
            columns.append(f"CAST(COALESCE(_position_{k}, {size}) AS DOUBLE) AS _place_{k}")
            one = OneHotEncoder(inputCols=[f"_place_{k}"], outputCols=[f"_onehot_{k}"], handleInvalid="keep", dropLast=True)
            encoders.append(one.fit(spark.createDataFrame([(float(size - 1),)], f"_place_{k} double")))
            assembled.append(f"_onehot_{k}")
            continue
        # A value names its slot by its place in the vocabulary; a binary count vector over the row's tokens is the
        # block, and unknown tokens count nothing.
        words = [f"{_token(i)}{value}" for i, c in enumerate(run) for value in known.listed[c]]
        if words:
            tokens = ", ".join(f"CONCAT('{_token(i)}', CAST(`{c}` AS STRING))" for i, c in enumerate(run))
            columns.append(f"FILTER(ARRAY({tokens}), t -> t IS NOT NULL) AS _tokens_{k}")
            block = CountVectorizerModel.from_vocabulary(words, inputCol=f"_tokens_{k}", outputCol=f"_onehot_{k}")
            encoders.append(block.setBinary(True))
            assembled.append(f"_onehot_{k}")
    names = [f"_n{i}" for i in range(len(scaled) + len(passed))]
    pieces = "".join(f", numbers[{i}] AS {name}" for i, name in enumerate(names))
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"), *encoders,
        SQLTransformer(statement=f"SELECT *{pieces} FROM __THIS__"),
        VectorAssembler(inputCols=assembled + names, outputCol="features"),
    ]
    if names:
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}) FROM __THIS__"))
    return Encoding(spec, known, stats, PipelineModel(stages))
