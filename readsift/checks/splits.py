"""Row positions, hold-outs, folds and seeded draws over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from readsift.checks.registering import Book
from readsift.operators import folds
from readsift.operators.rank import row_index, seeded_rank
from readsift.plans.run import curve_sizes
from readsift.sources.given import given

BOOK = Book()
query = BOOK.query

_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
_INDEXED = (
    f"indexed AS (SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS row_idx, "
    "l_orderkey, l_linenumber, l_linestatus FROM lineitem), "
    "size AS (SELECT count(*) AS n FROM lineitem)"
)
_SHARE = "CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT)"


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join([_INDEXED, *ctes]) + " " + select


def _ranked(seed: int, alias: str = "ranked", by: str = "l_linestatus", source: str = "indexed") -> str:
    partition = f"PARTITION BY {by} " if by else ""
    return (
        f"{alias} AS (SELECT *, row_number() OVER ({partition}ORDER BY md5(concat('{seed}', ':', CAST(row_idx AS VARCHAR))), row_idx) - 1 AS rank "
        f"FROM {source})"
    )


def indexed(spark, sf_dir):
    lines = row_index(given(spark, sf_dir, "lineitem"), _ORDER, from_scan=True)
    return lines.select("row_idx", "l_orderkey", "l_linenumber", "l_linestatus")


@query(_sql("SELECT * FROM indexed"))
def row_positions(spark, sf_dir):
    return indexed(spark, sf_dir)


@query(_sql("SELECT * FROM indexed WHERE row_idx < 1000"))
def positional_prefix(spark, sf_dir):
    """Rows before a position: a filter on the index, not a limit."""
    return indexed(spark, sf_dir).where(F.col("row_idx") < 1000)


@query(_sql(f"SELECT row_idx, l_linestatus, CASE WHEN row_idx < {_SHARE} THEN 'train' ELSE 'test' END AS role FROM indexed, size"))
def holdout_ordered(spark, sf_dir):
    df = indexed(spark, sf_dir)
    return folds.ordered_holdout(df, df.count(), 0.8).select("row_idx", "l_linestatus", "role")


_QUOTA = (
    f"target AS (SELECT n, {_SHARE} AS size FROM size), "
    "classes AS (SELECT l_linestatus AS c, count(*) AS k FROM lineitem GROUP BY l_linestatus), "
    "parts AS (SELECT c, size * k // n AS whole, row_number() OVER (ORDER BY size * k % n DESC, c) AS nth, size FROM classes, target), "
    "quota AS (SELECT c, whole + CASE WHEN nth <= size - (SELECT sum(whole) FROM parts) THEN 1 ELSE 0 END AS q FROM parts)"
)


@query(
    _sql(
        "SELECT row_idx, l_linestatus, CASE WHEN rank < q THEN 'train' ELSE 'test' END AS role "
        "FROM ranked JOIN quota ON c = l_linestatus",
        _QUOTA, _ranked(0),
    )
)
def holdout_stratified(spark, sf_dir):
    marked = folds.stratified_holdout(indexed(spark, sf_dir), "l_linestatus", 0.8, 0)
    return marked.select("row_idx", "l_linestatus", "role")


@query(
    _sql(
        f"SELECT row_idx, l_linestatus, CASE WHEN row_idx < CAST(floor(CAST(0.8 AS DOUBLE) * {_SHARE}) AS BIGINT) THEN 'train' ELSE 'test' END AS role "
        f"FROM indexed, size WHERE row_idx < {_SHARE}"
    )
)
def holdout_calibration(spark, sf_dir):
    """The train part of the ordered hold-out, split once more the same way."""
    df = indexed(spark, sf_dir)
    size = folds.ordered_train_size(df.count(), 0.8)
    inner = folds.ordered_holdout(df.where(F.col("row_idx") < size), size, 0.8)
    return inner.select("row_idx", "l_linestatus", "role")


@query(
    _sql(
        "SELECT row_idx, CAST(row_idx // (n // 10) AS INT) AS fold, "
        "CASE WHEN row_idx % (n // 10) < CAST(floor(CAST(0.8 AS DOUBLE) * (n // 10)) AS BIGINT) THEN 'train' ELSE 'test' END AS role "
        "FROM indexed, size WHERE row_idx // (n // 10) < 10"
    )
)
def folds_sliding(spark, sf_dir):
    df = indexed(spark, sf_dir)
    return folds.fold_membership(df, folds.sliding_folds(df.count(), 10, 0.8))


@query(
    _sql(
        "SELECT CAST(i AS INT) AS fold, CASE WHEN row_idx < n - (10 - i) * (n // 11) THEN 'train' ELSE 'test' END AS role, "
        "CAST(count(*) AS BIGINT) AS n_rows, CAST(min(row_idx) AS BIGINT) AS first_row, CAST(max(row_idx) AS BIGINT) AS last_row "
        "FROM indexed, size, range(10) g(i) WHERE row_idx < n - (9 - i) * (n // 11) GROUP BY 1, 2"
    )
)
def folds_expanding(spark, sf_dir):
    df = indexed(spark, sf_dir)
    members = folds.fold_membership(df, folds.expanding_folds(df.count(), 10))
    return members.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row")
    )


@query(_sql("SELECT row_idx, l_linestatus, CAST(rank % 10 AS INT) AS fold FROM ranked", _ranked(0)))
def folds_stratified(spark, sf_dir):
    dealt = folds.stratified_fold_column(indexed(spark, sf_dir), "l_linestatus", 10, 0)
    return dealt.select("row_idx", "l_linestatus", "fold")


@query(
    _sql(
        "SELECT row_idx, " + ", ".join(f"CAST(r{i}.rank % 10 AS INT) AS fold_{i}" for i in range(10)) + " FROM r0 "
        + " ".join(f"JOIN r{i} USING (row_idx)" for i in range(1, 10)),
        *[_ranked(i, f"r{i}") for i in range(10)],
    )
)
def folds_repeated_stratified(spark, sf_dir):
    dealt, _ = folds.repeated_stratified(indexed(spark, sf_dir), "l_linestatus", 10, 10, 0)
    return dealt.select("row_idx", *[f"fold_{i}" for i in range(10)])


@query(
    _sql(
        "SELECT row_idx, CAST(i AS INT) AS fold, CASE WHEN row_idx < 100 - (10 - i) * (100 // 11) THEN 'train' ELSE 'test' END AS role "
        "FROM indexed, range(10) g(i) WHERE row_idx < 100 - (9 - i) * (100 // 11)"
    )
)
def folds_of_first_hundred(spark, sf_dir):
    """The fold listing the experiment prints: membership of its first 100 rows."""
    head = indexed(spark, sf_dir).where(F.col("row_idx") < 100)
    return folds.fold_membership(head, folds.expanding_folds(100, 10))


@query(
    _sql(
        "SELECT a.row_idx, b.l_linestatus FROM indexed a JOIN ranked b ON b.rank = a.row_idx",
        _ranked(0, by=""),
    )
)
def permuted_labels(spark, sf_dir):
    return folds.permute_labels(indexed(spark, sf_dir), "l_linestatus", 0).select("row_idx", "l_linestatus")


@query(
    _sql(
        "SELECT i AS draw, x.row_idx, x.l_orderkey, x.l_linenumber, x.l_linestatus FROM range(10) g(i), size, indexed x "
        "WHERE x.row_idx = CAST('0x' || substr(md5(concat('0', ':', CAST(i AS VARCHAR))), 1, 12) AS BIGINT) % n"
    )
)
def drawn_rows(spark, sf_dir):
    """Ten seeded draws with replacement over all positions."""
    df = indexed(spark, sf_dir)
    return folds.draw_rows(df, df.count(), 10, 0)


@query(_sql("SELECT row_idx, rank FROM ranked", _ranked(7, by="")))
def seeded_shuffle(spark, sf_dir):
    return seeded_rank(indexed(spark, sf_dir), "row_idx", 7).select("row_idx", "rank")


@query(
    _sql(
        "SELECT CAST(s.size AS BIGINT) AS size, CAST(i AS INT) AS fold, CASE WHEN row_idx < m - (10 - i) * (m // 11) THEN 'train' ELSE 'test' END AS role, "
        "CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT CAST(floor(CAST(0.9 AS DOUBLE) * n * k / 20) AS BIGINT) AS size, "
        "CAST(floor(CAST(0.9 AS DOUBLE) * n * k / 20) AS BIGINT) + 1 AS m FROM size, range(1, 21) h(k)) s, "
        "indexed, range(10) g(i) WHERE row_idx < m - (9 - i) * (m // 11) GROUP BY ALL"
    )
)
def learning_curve_sizes(spark, sf_dir):
    """Expanding folds inside growing prefixes: size + 1 rows each, as the curve uses."""
    df = indexed(spark, sf_dir)
    return folds.expanding_fold_sizes(df, curve_sizes(df.count(), 20), 10)
