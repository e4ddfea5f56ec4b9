"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first run of each query compiles its plan and counts as the warm-up; the time is the second run's. throughput_mb_s is
payload bytes in over the seconds of the compress queries. perf_1 and perf_8 compact one and eight log-heavy payloads of 8 MiB,
made and written before the clock starts: the form in which throughput of a single core was published.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["split_lines", "exact_runs", "ws_runs", "mask_forms", "template_groups", "block_candidates", "sniff_schema", "span_inventory", "compress_logs", "compress_documents", "compress_conversations", "reduction_summary", "perf_1", "perf_8"]


def main() -> None:
    from pyspark.sql import SparkSession

    from plisse.functions.tables import materialize
    from plisse.plans.catalog import QUERIES
    from plisse.plans.compress import compress
    from plisse.sources import corpus

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds: dict[str, float] = {}
    megabytes: dict[str, float] = {}
    made = {name: materialize(corpus.perf_payloads(spark, int(name[5:])).select("payload_id", "body").repartition(int(name[5:])), name) for name in names if name.startswith("perf_")}
    for name in names:
        for _ in range(2):
            began = time.perf_counter()
            df = compress(made[name]) if name in made else QUERIES[name](spark, SF_DIR)
            if name.startswith(("compress_", "perf_")):
                megabytes[name] = df.agg({"bytes_in": "sum", "bytes_out": "sum"}).first()["sum(bytes_in)"] / 1e6
            else:
                df.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
            spark.catalog.clearCache()
    rates = {k: round(v / seconds[k], 3) for k, v in megabytes.items()}
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "throughput_mb_s": rates, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
