"""Run registered queries against their SQL: python tests/check_catalog.py SF_DIR [name part ...]"""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import catalog  # noqa: E402
from catalog.compare import compare, connect  # noqa: E402
from repograph.ship import ship_packages  # noqa: E402


def main(sf_dir, wanted):
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ship_packages(spark, os.path.join(root, "repograph"), os.path.join(root, "catalog"))
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in catalog.ORACLES:
                problems = compare(df, con, catalog.ORACLES[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("    ", p[:900], flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
