"""spark-submit entry point: reconcile files and print a summary."""

import argparse
import sys
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tallyframe.config import ReconConfig, load_config
from tallyframe.errors import ReconError
from tallyframe.operators import metrics
from tallyframe.operators.skew import SESSION_SETTINGS
from tallyframe.plans.run import run
from tallyframe.sources.files import expand
from tallyframe.sources.sinks import summary_text
from tallyframe.storage import clear


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyframe")
    parser.add_argument("--crm", required=True, help="master file")
    parser.add_argument("--reports", required=True, nargs="+", help="report files, or folders of them")
    parser.add_argument("--sheet", help="sheet to read in workbooks, else the first")
    parser.add_argument("--config", help="YAML settings")
    parser.add_argument("--output", help="folder of the results")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("tallyframe")
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        config = load_config(args.config) if args.config else ReconConfig()
        if args.output:
            config = replace(config, output_directory=args.output)
        done = run(spark, args.crm, expand(spark, args.reports), config, sheet=args.sheet,
                   run_ts=datetime.now(UTC).isoformat().replace("+00:00", "Z"))
        types = metrics.breakdown_by_type(done.result.discrepancies).collect()
        print(summary_text(done.summary.first().asDict(), [(r["discrepancy_type"], r["count"]) for r in types]))
        clear(spark)
        return 0
    except ReconError as err:
        print(f"Error: {err}", file=sys.stderr)
        return 1
    except Exception as err:  # anything else is a defect, told apart by its exit code
        print(f"Unexpected error: {err}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
