"""Time the headline queries, median of the runs, with shuffle bytes: prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_RUNS (timed runs).
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import compare, match
from tallyframe.operators.dedup import dedup_first, duplicates
from tallyframe.operators.skew import SESSION_SETTINGS
from tallyframe.plans.reconcile import reconcile
from tallyframe.schema import REPORT, conform
from workload.fields import COPIES, derive
from workload.inputs import report_table
from workload.recon import CONFIG, EXACT_ONLY, sides

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def drain(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def exact(spark):
    crm, reports = sides(spark, FOLDER)
    drain(match.exact_match(reports, crm))


def compared(spark):
    crm, reports = sides(spark, FOLDER)
    aligned = match.align(reports, crm, EXACT_ONLY.matching, cut=lambda df: df)
    drain(compare.report_discrepancies(aligned, CONFIG))


def fuzzy(spark):
    crm, reports = sides(spark, FOLDER)
    drain(match.align(reports, crm, CONFIG.matching).filter("match_route != 'EXACT_PAN'"))


def dedup(spark):
    rows = conform(derive(spark, FOLDER, COPIES, rep=report_table(spark, FOLDER)), REPORT)
    drain(dedup_first(rows))
    drain(duplicates(rows))


def full(spark):
    crm, reports = sides(spark, FOLDER)
    drain(reconcile(crm, reports, CONFIG).discrepancies)


QUERIES = {"exact_match": exact, "compare": compared, "fuzzy_match": fuzzy, "dedup": dedup, "reconcile": full}


def hot(spark):
    """Match with one PAN on a third of the report rows and one mobile on another third."""
    crm, reports = sides(spark, FOLDER)
    row = F.col("raw_row_index") % 3
    first = crm.orderBy("crm_order").select("pan", "mobile").first()
    skewed = reports.withColumn("pan", F.when(row == 0, first["pan"]).when(row == 1, "ZZZZZ0000Z").otherwise(F.col("pan")))
    skewed = skewed.withColumn("mobile", F.when(row == 1, first["mobile"]).otherwise(F.col("mobile")))
    drain(match.align(skewed, crm, CONFIG.matching))


QUERIES["hot_keys"] = hot


def shuffled(folder: str, spans: dict[str, list[tuple[float, float]]]) -> dict[str, int]:
    """Shuffle bytes written per run of each query, by the event log's task times."""
    total = dict.fromkeys(spans, 0)
    for name in os.listdir(folder):
        with open(os.path.join(folder, name), errors="replace") as log:
            for line in log:
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                event = json.loads(line)
                at = event["Task Info"]["Launch Time"] / 1000
                size = ((event.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                for query, parts in spans.items():
                    if any(a <= at <= b for a, b in parts):
                        total[query] += size
    return {q: n // max(1, len(spans[q])) for q, n in total.items()}


def main() -> None:
    events = tempfile.mkdtemp(prefix="bench-events-")
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{events}").config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", "false")
    )
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    spans: dict[str, list[tuple[float, float]]] = {}
    for name, run in QUERIES.items():
        run(spark)  # warm-up
        taken = []
        for _ in range(RUNS):
            began, start = time.time(), time.perf_counter()
            run(spark)
            taken.append(time.perf_counter() - start)
            spans.setdefault(name, []).append((began, time.time()))
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    crm, reports = sides(spark, FOLDER)
    records = crm.count() + reports.count()
    spark.stop()
    print(json.dumps({
        "shuffle_bytes": shuffled(events, spans),
        "metric": "reconcile_seconds", "value": times["reconcile"], "unit": "sec", "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "records": records,
        "records_per_sec": round(records / times["reconcile"], 1),
    }))


if __name__ == "__main__":
    main()
