"""Feature builders, files, profiling and encoding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from readsift import config
from readsift.checks.registering import Book
from readsift.checks.warehouse_sql import extraction
from readsift.operators import profile
from readsift.plans import features, reads
from readsift.plans.frame import experiment_frame
from readsift.schemas import EXCEPTION_SCHEMA
from readsift.session import stage, staged_path
from readsift.sources import files
from readsift.sources.derived import SINCE, derived_warehouse

BOOK = Book()
query = BOOK.query

_FEATURES = [c for c in EXCEPTION_SCHEMA.fieldNames() if c not in features.IDENTIFIERS]
_FEATURE_SQL = ", ".join(_FEATURES)
_DATED_SQL = f"{_FEATURE_SQL}, CAST(READ_DTM AS DATE) AS Date, label AS Status"
_ROW = "row_number() OVER (ORDER BY READ_DTM, METER_ID, CHANNEL_ID, {rest}) - 1 AS row_idx"
INDEXED_SQL = "SELECT {}, {} FROM wide".format(
    _ROW.format(rest=", ".join(f"{c} NULLS FIRST" for c in [*EXCEPTION_SCHEMA.fieldNames(), "label"] if c != "METER_ID")),
    _DATED_SQL,
)


def labelled(spark, sf_dir, keep=()):
    return reads.labelled_reads(derived_warehouse(spark, sf_dir), SINCE, keep=keep)


def frame(spark, sf_dir):
    return experiment_frame(derived_warehouse(spark, sf_dir), SINCE)


@query(
    extraction(
        "labelled", 2,
        "SELECT CHANNEL_ID, CAST(month(READ_DTM) AS INT) AS MONTH, CAST(day(READ_DTM) AS INT) AS DAY, READ_VALUE FROM wide",
    )
)
def features_day_month(spark, sf_dir):
    wide = labelled(spark, sf_dir, keep=("read_dtm", "channel_id"))
    raw = wide.select(
        F.col("read_dtm").alias("READ_DTM"), "METER_ID", F.col("channel_id").alias("CHANNEL_ID"), "READ_VALUE"
    )
    return features.read_time_features(raw)


@query(extraction("labelled", 2, f"SELECT {_FEATURE_SQL}, label AS Status FROM wide"))
def features_exception(spark, sf_dir):
    return features.exception_features(labelled(spark, sf_dir))


@query(extraction("labelled", 2, f"SELECT {_DATED_SQL} FROM wide"))
def features_time_series(spark, sf_dir):
    return features.time_series_features(labelled(spark, sf_dir))


@query(extraction("labelled", 2, f"SELECT {_FEATURE_SQL}, label AS Status FROM wide"))
def features_hashed_location(spark, sf_dir):
    hashed = labelled(spark, sf_dir).withColumn("LOCATION_HASH", F.sha2(F.col("LOCATION_NO").cast("string"), 256))
    return features.hashed_location_features(hashed.drop("LOCATION_NO"))


@query(extraction("labelled", 2, INDEXED_SQL))
def features_by_date(spark, sf_dir):
    """The experiment frame: features in date order with their position."""
    return frame(spark, sf_dir)


@query(extraction("labelled", 2, "SELECT label AS Status FROM wide"))
def label_split(spark, sf_dir):
    return features.split_label(labelled(spark, sf_dir))[1]


_NO_LOCATION = [c for c in _FEATURES if c != "LOCATION_CLASS"]


@query(
    extraction("labelled", 2, f"SELECT {', '.join(_NO_LOCATION)} FROM wide")
)
def align_columns(spark, sf_dir):
    """The frame cut to the columns of a model without location."""
    return features.align_to(labelled(spark, sf_dir), _NO_LOCATION)


@query(
    extraction(
        "labelled", 2,
        "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in (*config.NUMERICAL_COLUMNS, *config.BINARY_COLUMNS))
        + " FROM wide",
    )
)
def features_as_doubles(spark, sf_dir):
    columns = (*config.NUMERICAL_COLUMNS, *config.BINARY_COLUMNS)
    return features.as_doubles(labelled(spark, sf_dir).select(*columns), columns)


@query(extraction("labelled", 2, f"SELECT {', '.join(EXCEPTION_SCHEMA.fieldNames())} FROM wide"))
def checked_raw_frame(spark, sf_dir):
    """The raw stage passes a frame on unchanged after its schema check."""
    wide = labelled(spark, sf_dir).drop("Status")
    return features.checked(wide, EXCEPTION_SCHEMA)


@query(
    extraction(
        "labelled", 2,
        f"SELECT * FROM ({INDEXED_SQL}) ORDER BY row_idx LIMIT 10",
    )
)
def preview_rows(spark, sf_dir):
    return files.preview(frame(spark, sf_dir), ["row_idx"])


@query(
    extraction(
        "labelled", 2,
        f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(_FEATURES) + 2} AS INT) AS n_columns FROM wide",
    )
)
def frame_shape(spark, sf_dir):
    made = features.time_series_features(labelled(spark, sf_dir), sort=False)
    return made.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(made.columns)))


@query(extraction("labelled", 2, f"SELECT {', '.join(EXCEPTION_SCHEMA.fieldNames())} FROM wide"))
def csv_round_trip(spark, sf_dir):
    path = staged_path(spark, "csv")
    files.write_csv(labelled(spark, sf_dir).drop("Status"), path)
    return files.read_csv(spark, path, EXCEPTION_SCHEMA)


@query(extraction("labelled", 2, f"SELECT {_FEATURE_SQL}, CAST(READ_DTM AS DATE) AS Date FROM wide"))
def stage_chain(spark, sf_dir):
    """Raw CSV to interim to processed features, read back from the last stage."""
    root = staged_path(spark, "chain")
    files.write_csv(labelled(spark, sf_dir).drop("Status"), f"{root}/raw/exceptions.csv")
    build = features.time_series_features
    target = files.run_stages(
        spark, "exceptions.csv", f"{root}/raw", f"{root}/interim", f"{root}/processed", EXCEPTION_SCHEMA, build
    )
    schema = EXCEPTION_SCHEMA.fieldNames()
    kept = [EXCEPTION_SCHEMA[c] for c in schema if c in _FEATURES]
    from pyspark.sql.types import DateType, StructField, StructType

    return files.read_csv(spark, target, StructType([*kept, StructField(config.DATE_COLUMN, DateType())]))


@query(extraction("labelled", 2, f"SELECT {', '.join(EXCEPTION_SCHEMA.fieldNames())} FROM wide WHERE YEAR = 2024 AND MONTH = 1"))
def parquet_by_month(spark, sf_dir):
    """Parquet sink partitioned by month, read back through partition pruning."""
    path = staged_path(spark, "frame")
    files.write_frame(labelled(spark, sf_dir).drop("Status"), path)
    stored = spark.read.schema(EXCEPTION_SCHEMA).parquet(path)
    return stored.where((F.col("YEAR") == 2024) & (F.col("MONTH") == 1)).select(*EXCEPTION_SCHEMA.fieldNames())


def _counts_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM wide GROUP BY {c}"
        for c in columns
    )


@query(extraction("labelled", 2, _counts_sql(config.CATEGORICAL_COLUMNS[:16])))
def profile_categoricals(spark, sf_dir):
    return profile.value_counts(labelled(spark, sf_dir), config.CATEGORICAL_COLUMNS[:16])


@query(extraction("labelled", 2, _counts_sql(config.BINARY_COLUMNS)))
def profile_binaries(spark, sf_dir):
    return profile.value_counts(labelled(spark, sf_dir), config.BINARY_COLUMNS)


@query(extraction("labelled", 2, _counts_sql(["label"]).replace("'label'", "'Status'")))
def profile_label(spark, sf_dir):
    return profile.value_counts(labelled(spark, sf_dir), [config.TARGET_COLUMN])


def histogram_sql(source: str, columns) -> str:
    """Ten equal bins by edges ``lo + i * ((hi - lo) / 10)``, empty ones kept."""
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(k.i AS INT) AS bin, k.lo, k.hi, CAST(count(s.x) AS BIGINT) AS n FROM ("
            f"SELECT i, m.lo + i * ((m.hi - m.lo) / 10) AS lo, "
            f"CASE WHEN i = 9 THEN m.hi ELSE m.lo + (i + 1) * ((m.hi - m.lo) / 10) END AS hi "
            f"FROM range(10) g(i), (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}) m) k "
            f"LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS x FROM {source}) s "
            f"ON (s.x >= k.lo OR k.i = 0) AND (s.x < k.hi OR k.i = 9) GROUP BY k.i, k.lo, k.hi"
        )
    return " UNION ALL ".join(parts)


@query(
    extraction("labelled", 2, histogram_sql("wide", config.NUMERICAL_COLUMNS)),
    rounded=('lo', 'hi'),
)
def profile_histograms(spark, sf_dir):
    return profile.histograms(labelled(spark, sf_dir), config.NUMERICAL_COLUMNS)


@query(
    extraction(
        "labelled", 2,
        "SELECT \"column\", value, row_number() OVER (ORDER BY i, TRY_CAST(value AS DOUBLE), value) - 1 AS slot, "
        "row_number() OVER (PARTITION BY i ORDER BY TRY_CAST(value AS DOUBLE), value) - 1 AS position FROM ("
        + " UNION ".join(
            f"SELECT {i} AS i, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM wide"
            for i, c in enumerate(config.CATEGORICAL_COLUMNS)
        )
        + ")",
    )
)
def category_vocabulary(spark, sf_dir):
    return profile.vocabulary(labelled(spark, sf_dir), config.CATEGORICAL_COLUMNS)


@query(
    extraction(
        "labelled", 2,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS std FROM wide" for c in config.NUMERICAL_COLUMNS
        ),
    ),
    rounded=('mean', 'std'),
)
def numeric_moments(spark, sf_dir):
    return profile.moments(labelled(spark, sf_dir), config.NUMERICAL_COLUMNS)


@query(
    extraction(
        "labelled", 2,
        "SELECT \"column\", mean, std FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS std FROM wide" for c in config.NUMERICAL_COLUMNS
        ) + ") WHERE mean IS NULL AND std IS NOT NULL",
    )
)
def moments_that_partitions_change(spark, sf_dir):
    """Moments that differ, in any bit, between two partitionings of all reads: none."""
    df = stage(labelled(spark, sf_dir).select(*config.NUMERICAL_COLUMNS), "moments")
    few, many = (profile.moments(df.repartition(k), config.NUMERICAL_COLUMNS) for k in (3, 11))
    return few.exceptAll(many).unionByName(many.exceptAll(few))
