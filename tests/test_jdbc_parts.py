"""Parts of relations read over JDBC. No database runs here: the predicates are tested on rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from readsift.schemas import WAREHOUSE_SCHEMAS
from readsift.sources.tables import CUT_OFF, column_types, month_starts, read_predicates

SINCE, UNTIL = datetime(2019, 1, 15, 6), datetime(2019, 4, 1)


@pytest.mark.parametrize("name", sorted(WAREHOUSE_SCHEMAS))
@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_every_wanted_row_is_in_one_part(spark, name, partitions):
    instants = [None, SINCE - timedelta(seconds=1), SINCE, datetime(2019, 2, 1), datetime(2019, 3, 31, 23, 59, 59), UNTIL, datetime(2030, 1, 1)]
    rows = [(m, t) for m in (None, -5, 0, 9, 10, 11, 25, 39, 40, 1000) for t in instants]
    df = spark.createDataFrame(rows, "meter_id bigint, read_dtm timestamp_ntz")
    parts = read_predicates(name, (10, 40), partitions, SINCE, UNTIL)
    hits = sum((F.when(F.expr(p), 1).otherwise(0) for p in parts), F.lit(0))
    for r in df.withColumn("hits", hits).collect():
        dated = name in CUT_OFF
        assert r.hits == int(not dated or (r.read_dtm is not None and r.read_dtm >= SINCE)), (name, r)
    if "meter_id" in WAREHOUSE_SCHEMAS[name].fieldNames() and partitions == 4:
        months = 3 if name in CUT_OFF else 4 if "read_dtm" in WAREHOUSE_SCHEMAS[name].fieldNames() else 1
        assert len(parts) == 4 * months
    # Without instants there are meter ranges alone.
    assert not any("read_dtm" in p for p in read_predicates(name, (10, 40), partitions))


def test_months_and_types(spark):
    assert month_starts(datetime(2019, 11, 5), datetime(2020, 2, 1)) == [datetime(2019, 11, 5), datetime(2019, 12, 1), datetime(2020, 1, 1)]
    assert month_starts(datetime(2019, 11, 5), datetime(2019, 11, 1)) == [datetime(2019, 11, 5)]
    for name, schema in WAREHOUSE_SCHEMAS.items():
        read = _parse_datatype_string(column_types(name))
        assert [(f.name, f.dataType) for f in read] == [(f.name, f.dataType) for f in schema]
