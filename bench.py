"""Headline timings on $BENCH_SF_DIR: constraints 11 and 12 over the cube of all order lines, and the sales cube's.

The metric is the time of constraints 11 and 12 over a loaded cube. Loading it (load_lines) is reported on its own: mapping the table
to triples, storing and normalizing them, and the star table of observations.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from cubeloom import queries as q

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, rows = {}, {}

    def timed(name, run):
        began = time.time()
        rows[name] = run()
        took[name] = round(time.time() - began, 2)

    timed("load_lines", lambda: q.context(q.line_points, spark, SF_DIR).star.count())
    for name in ("ic11_lines", "ic12_line_pairs", "ic12_lines", "ic12_line_classes"):
        timed(name, lambda name=name: q.QUERIES[name](spark, SF_DIR).count())
    timed("load_sales", lambda: q.context(q.sales, spark, SF_DIR).star.count())
    for name in ("ic01", "ic10", "ic11", "ic12", "ic13", "ic18", "ic19", "ic20"):
        timed(name, lambda name=name: q.QUERIES[name](spark, SF_DIR).count())
    small = SF_DIR.rsplit("/", 1)[0] + "/sf0.01"  # 15,000 observations, about as many as the smaller published case has
    if os.path.isdir(small):
        q.context(q.sales, spark, small).star.count()
        timed("ic12_15000", lambda: q.QUERIES["ic12"](spark, small).count())
    value = round(took["ic11_lines"] + took["ic12_line_pairs"], 2)
    print(json.dumps({"metric": f"constraints 11 and 12 over {rows['load_lines']} observations", "value": value, "unit": "sec", "queries": took, "rows": rows, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
