"""Compare registered queries with their SQL: ``python tests/run_queries.py [name…]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from comparing import connect, difference, type_differences  # noqa: E402


def main(names):
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not names or any(n.startswith(p) for p in names)]:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                types = type_differences(df, con, oracles[name])
                outcome = f"ok {types or ''}" if problem is None else f"DIFFERENT {problem[:900]}"
            else:
                outcome = f"ok, {df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            outcome = f"FAILED {type(error).__name__}: {str(error)[:700]}"
        bad += not outcome.startswith("ok")
        print(f"{name}: {outcome} [{time.time() - began:.1f}s]", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
