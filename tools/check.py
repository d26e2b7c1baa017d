"""Compare registered queries with their oracle: check.py [sf_dir] [name ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from readsift.checks import registry  # noqa: E402
from readsift.checks.compare import compare, duck  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), registry.oracles(), 0
    for name, function in registry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, message, took = compare(spark, con, sf_dir, name, function, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, message, took = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {took:6.2f}s {name}: {message}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
