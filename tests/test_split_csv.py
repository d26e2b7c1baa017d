"""CSV files with quoted line breaks, read by several tasks."""

import csv
import random
from collections import Counter

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from readsift.sources import files

SCHEMA = StructType([StructField("a", StringType()), StructField("n", IntegerType()), StructField("b", StringType())])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def _rows(seed, n):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['x', '"', "\n", ",", " ", "é", '""', "\r"]) for _ in range(r.randrange(12)))
    made = [(text() or None, r.randrange(1000), text() + "z") for _ in range(n)]
    # One field over many splits, of line breaks and quotes.
    return [*made, ('"\n' * 2500, 1, "\n" * 3000), ("", 2, "last")]


def test_split_files_hold_the_rows_of_whole_files(spark, tmp_path, small_splits):
    made = _rows(1, 400)
    path = str(tmp_path / "t")
    files.write_csv(spark.createDataFrame(made, SCHEMA).coalesce(2), path)
    found = files.read_csv(spark, path, SCHEMA)
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 10
    whole = files.read_csv(spark, path, SCHEMA, split=False)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, whole.collect())) == Counter(made)


def test_file_of_another_writer(spark, tmp_path, small_splits):
    made = [(f'say "{i}"\nnext, {"long " * (i % 40)}', i, "x") for i in range(200)]
    with open(tmp_path / "o.csv", "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["a", "n", "b"])
        writer.writerows(made)
        out.write("\n")
    assert Counter(map(tuple, files.read_csv(spark, str(tmp_path / "o.csv"), SCHEMA).collect())) == Counter(made)


def test_wrong_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,m,b\n1,2,3\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "w.csv"), SCHEMA, split=True)
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), SCHEMA, split=True).count() == 0
    (tmp_path / "h.csv").write_text("a,n,b\n")
    assert files.read_csv(spark, str(tmp_path / "h.csv"), SCHEMA, split=True).count() == 0
    (tmp_path / "m.csv").write_text("a,n,b\nx,no number,y\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.read_csv(spark, str(tmp_path / "m.csv"), SCHEMA, split=True).collect()
