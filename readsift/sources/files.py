"""CSV and parquet ends of the stage chain raw -> interim -> processed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from readsift.plans.features import checked
from readsift.session import stage

FILES_PER_PART = 8
PROCESSED_SUFFIX = "_time_series"
# An unquoted empty field is NULL whatever this is; as "" it would take quoted empty fields along.
_NO_VALUE = "\x01no value\x01"
_CSV = {
    "quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, schema: StructType, split: bool | None = None) -> DataFrame:
    """Scan CSV with a header line; a header that disagrees with the schema fails.

    Quotes inside a field are doubled, and a quoted field may hold line breaks. Blanks around a value belong to it, an
    empty field is NULL and a quoted empty one is the empty text. Files larger than ``spark.sql.files.maxPartitionBytes``
    are read by several tasks (:func:`split_records`); smaller ones each by one. ``split`` asks for either way, the rows
    are the same."""
    if split is None:
        most = spark.sql("SET spark.sql.files.maxPartitionBytes").first()["value"]
        split = _largest_file(spark, path) > spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most)
    options = {"enforceSchema": False, "mode": "FAILFAST", "emptyValue": "", "nullValue": _NO_VALUE, **_CSV}
    if not split:
        return spark.read.csv(path, schema=schema, header=True, multiLine=True, **options)
    records = split_records(spark, path)
    names = StructType([StructField(f"c{i}", StringType()) for i in range(len(schema))])
    text = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "enforceSchema"}
    # One line per file, most of them equal.
    for (header,) in records.where("header").select(F.from_csv("record", names.simpleString()[7:-1].replace(":", " "), text)).distinct().collect():
        if [str(name) for name in header] != schema.fieldNames():
            raise ValueError(f"header {list(header)} is not {schema.fieldNames()}")
    parsed = F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), text)
    return records.where("NOT header").select(parsed.alias("row")).select("row.*")


def _largest_file(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
    return max((s.getLen() for s in found if not s.getPath().getName().startswith(("_", "."))), default=0)


_RECORDS = "file string, start bigint, kind int, header boolean, record string"
_WHOLE, _END, _MIDDLE, _BEGIN = -1, 0, 1, 2


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, record) of CSV files whose quoted fields may hold line breaks, read split by split.

    A line break ends a record only outside quotes, which a split can't tell from its own bytes. But quotes come in
    pairs: the parity of the quotes of all splits before says how a split begins. So one pass counts quotes per split,
    their running parity goes to the splits, and each is cut into records; what begins in one split and ends in a later
    one is put together from its pieces, at most two a split. Empty lines are no records.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "start").agg(quotes.alias("quotes")).select(
        "file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside")
    )
    # One row per split. A scan yields the lines of a split in order, and the join keeps it.
    cut = stage(lines.join(F.broadcast(splits), ["file", "start"]).mapInPandas(_records, _RECORDS), "csv-records")
    pieces = cut.where(F.col("kind") != _WHOLE)
    along = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.withColumn("nth", F.sum((F.col("kind") == _BEGIN).cast("int")).over(along))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = numbered.groupBy("file", "nth").agg(
        F.max("header").alias("header"), F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")
    )
    return cut.where((F.col("kind") == _WHOLE) & (F.col("record") != "")).select("header", "record").unionByName(joined.select("header", "record"))


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made: list[tuple] = []
    split, inside, began_here, first, held = None, False, True, False, []

    def piece(kind: int) -> None:
        nonlocal first, held
        made.append((*split, kind, first and split[1] == 0, "\n".join(held)))
        first, held = False, []

    for pdf in batches:
        for file, start, before, line in zip(pdf["file"], pdf["start"], pdf["inside"], pdf["value"]):
            if (file, start) != split:
                if held:
                    piece(_BEGIN if began_here else _MIDDLE)
                split, inside, began_here, first = (file, start), bool(before), not before, True
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                piece(_WHOLE if began_here else _END)
                began_here = True
        if made:
            yield pd.DataFrame(made, columns=["file", "start", "kind", "header", "record"])
            made = []
    if held:
        piece(_BEGIN if began_here else _MIDDLE)
        yield pd.DataFrame(made, columns=["file", "start", "kind", "header", "record"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue='""', nullValue="", **_CSV)


def write_frame(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("YEAR", "MONTH")) -> None:
    """Parquet sink laid out by calendar month, so later scans prune by date.

    Rows of a month meet in few tasks first, so that a month is not one small file per task; the spread keeps a large
    month from being one task's."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(FILES_PER_PART))
    writer = (df.repartition(*partition_by, spread) if partition_by else df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def preview(df: DataFrame, order_by, rows: int = 10) -> DataFrame:
    """The first rows in a stated order (a top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(rows)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def processed_name(file_name: str, suffix: str = PROCESSED_SUFFIX) -> str:
    """Name of the processed file: the part before the first dot, plus the suffix."""
    name = PurePosixPath(file_name)
    return f"{name.name.split('.')[0]}{suffix}{name.suffix}"


def run_stages(
    spark: SparkSession,
    file_name: str,
    raw_dir: str,
    interim_dir: str,
    processed_dir: str,
    schema: StructType,
    build: Callable[[DataFrame], DataFrame],
) -> str:
    """Check the raw CSV, keep it as interim, build features from the interim copy."""
    write_csv(checked(read_csv(spark, f"{raw_dir}/{file_name}", schema), schema), f"{interim_dir}/{file_name}")
    target = f"{processed_dir}/{processed_name(file_name)}"
    write_csv(build(read_csv(spark, f"{interim_dir}/{file_name}", schema)), target)
    return target
