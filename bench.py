"""Headline queries on one machine; prints one JSON line.

The three input views are written once, as a close would find its tables on disk. Row
checks and the whole close start from them with nothing kept from a query before; the
analyses start from the written tables of one close. Whole results are produced.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans import catalog  # noqa: E402
from ledgerloom.settings import configure  # noqa: E402

FROM_SOURCES = ["batch_nets", "fee_overcharges", "duplicate_captures", "ledger_coverage",
                "unsettled_revenue", "cross_cycle_refunds", "digits_by_method",
                "settlement_csv_round_trip", "close_findings"]
FROM_A_CLOSE = ["match_findings", "close_digest", "cash_position", "materiality_sweep",
                "forecast_backtest", "score_by_class", "auto_clear", "risk_dataset"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    start = time.perf_counter()
    views = tuple(catalog.sources(spark, sf_dir))
    setup = time.perf_counter() - start
    records = sum(v.count() for v in views)
    run(catalog.QUERIES["close_findings"](spark, sf_dir))  # one warm pass of the whole close
    seconds = {}

    def measure(name):
        start = time.perf_counter()
        run(catalog.QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)

    for name in FROM_SOURCES:
        catalog.forget()
        catalog.keep_sources(spark, sf_dir, views)
        measure(name)
    catalog.closed(spark, sf_dir)
    catalog.labels(spark, sf_dir)
    for name in FROM_A_CLOSE:
        measure(name)
    print(json.dumps({
        "metric": "settlement close queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "records": records, "source_setup_sec": round(setup, 3),
        "close_records_per_sec": round(records / seconds["close_findings"])}))
    spark.stop()


if __name__ == "__main__":
    main()
