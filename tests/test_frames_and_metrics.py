import pytest
from pyspark.sql import functions as F, types as T

from readsift.functions import calendar
from readsift.operators import metrics, profile
from readsift.plans import features
from readsift.schemas import EXCEPTION_SCHEMA, WAREHOUSE_SCHEMAS, exception_columns
from readsift.sources import files
from readsift.sources.derived import derived_warehouse
from readsift.sources.tables import from_parquet, to_parquet


def test_column_sets():
    assert len(exception_columns(2)) == 41 and len(exception_columns(1)) == 28
    assert len([c for c in exception_columns(2) if c not in features.IDENTIFIERS]) == 36
    with pytest.raises(ValueError):
        exception_columns(3)


def test_processed_name():
    assert files.processed_name("reads_2020.csv") == "reads_2020_time_series.csv"
    assert files.processed_name("a.b.csv") == "a_time_series.csv"


def test_derived_warehouse_has_the_declared_columns_and_survives_parquet(spark, small_dir, tmp_path):
    wh = derived_warehouse(spark, small_dir)
    for name, df in wh.tables().items():
        assert set(df.columns) == set(WAREHOUSE_SCHEMAS[name].fieldNames()), name
        for f in WAREHOUSE_SCHEMAS[name]:
            assert df.schema[f.name].dataType == f.dataType, (name, f.name)
    to_parquet(wh, str(tmp_path))
    again = from_parquet(spark, str(tmp_path))
    assert again.registerreads.count() == wh.registerreads.count()


def test_csv_with_another_header_fails(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, "x, \"y\""), (2, None)], schema)
    files.write_csv(df, str(tmp_path / "good"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "good"), schema).collect()} == {(1, 'x, "y"'), (2, None)}
    files.write_csv(df.withColumnRenamed("b", "z"), str(tmp_path / "bad"))
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad"), schema).collect()


def test_schema_check_and_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "METER_ID int")
    with pytest.raises(ValueError):
        features.checked(df, EXCEPTION_SCHEMA)
    with pytest.raises(TypeError):
        features.checked(df, T.StructType([T.StructField("METER_ID", T.LongType())]))
    with pytest.raises(ValueError):
        features.exception_features(df)
    with pytest.raises(ValueError):
        features.align_to(df, ["METER_ID", "X"])


def test_bad_date_raises(spark):
    row = {c: 1 for c in features.IDENTIFIERS} | {"YEAR": 2024, "MONTH": 2, "DAY": 30}
    with pytest.raises(Exception):
        features.time_series_features(spark.createDataFrame([row])).collect()


def test_clock_and_rounding(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-01 00:21:00' AS a, TIMESTAMP_NTZ '2024-01-01 12:00:00' AS b, "
        "TIMESTAMP_NTZ '2024-01-03 12:00:00.5' AS c"
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(
        calendar.clock_hour(a).alias("midnight"), calendar.clock_hour(b).alias("noon"), calendar.day_name(a).alias("dow"),
        calendar.rounded_days(b, F.lit("2024-01-04").cast("date")).alias("half"),
        calendar.rounded_days(b, F.lit("2023-12-30").cast("date")).alias("minus_half"),
        calendar.micros(c).alias("us"),
    ).first()
    assert (got.midnight, got.noon, got.dow) == (12, 12, "MON")
    assert (got.half, got.minus_half) == (3.0, -3.0)
    assert got.us == 1704283200500000


def test_since_ignores_the_zones(spark):
    from datetime import datetime

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.range(1).select(calendar.ntz(datetime(2024, 3, 10, 2, 30, 0, 5)).alias("t")).first().t
        assert got == datetime(2024, 3, 10, 2, 30, 0, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spark.range(1).select(calendar.ntz(None).alias("t")).first().t is None


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from readsift.session import staging_root

    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        staging_root(Session())
    assert staging_root(spark)


def test_expressions_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS t")
    shown = lambda: df.select(calendar.micros(F.col("t")), calendar.day_name(F.col("t")), calendar.clock_hour(F.col("t"))).first()
    here = shown()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert shown() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_precision_without_positive_calls_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert metrics.scores(df, ("precision", "recall")).first() == (0.0, 0.0)
    cells = metrics.confusion(df).first()
    assert (cells.tn, cells.fp, cells.fn, cells.tp) == (1, 0, 1, 0) and cells.tn_share == 0.5


def test_reliability_edges_put_equal_scores_low(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.3, 1), (1.0, 1)], "p1 double, label int")
    assert {r.bin for r in metrics.calibration_curve(df).collect()} == {0, 2, 9}
    counts = {r.bin: r.n for r in metrics.probability_histogram(df).collect()}
    assert len(counts) == 10 and (counts[0], counts[1], counts[2], counts[9]) == (1, 1, 1, 1)


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    cells = profile.histograms(df, ["x"]).collect()
    assert sum(r.n for r in cells) == 2 and min(r.lo for r in cells) == 1.5


def test_vocabulary_sorts_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, None)], "n int, s string")
    got = {(r.column, r.value): (r.slot, r.position) for r in profile.vocabulary(df, ["n", "s"]).collect()}
    assert got == {("n", "9"): (0, 0), ("n", "10"): (1, 1), ("s", "a"): (2, 0), ("s", "b"): (3, 1)}
