"""Outputs of a run and the history of runs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import ReconConfig
from tallyframe.operators.skew import attach, fits_broadcast
from tallyframe.schema import FAILED_FILE

FORMATS = ("excel", "csv", "json")

_RECORD = (
    "pan", "investor_name", "mobile", "email", "kyc_status", "fatca_status", "investor_status",
    "last_transaction_date", "total_amount",
)


def output_formats(config: ReconConfig) -> list[str]:
    """The override, else the defaults, else all. Workbook layout is not built: its content is in
    the views, and `excel` selects the tabular form of it."""
    chosen = config.reporting.formats
    if chosen is None:
        chosen = config.reporting.default_output_formats
    return [f.lower() for f in (chosen or FORMATS)]


def _or_blank(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c.cast("string"), F.lit(""))


def discrepancy_export(discrepancies: DataFrame) -> DataFrame:
    info = F.col("source_info")

    def from_info(key: str) -> Column:
        return F.coalesce(F.try_element_at(info, F.lit(key)), F.lit("N/A")).alias(key)

    return discrepancies.select(
        "discrepancy_type", "pan", *[_or_blank(c).alias(c) for c in ("field_name", "crm_value", "report_value")],
        "severity", "explanation", from_info("file_name"), from_info("raw_row_index"), from_info("folio_number"),
    )


def _record(prefix: str = "") -> list[Column]:
    out = []
    for f in _RECORD:
        c = F.col(f"{prefix}total_amount_text") if f == "total_amount" else F.col(f"{prefix}{f}")
        out.append(_or_blank(c).alias(f))
    return out


def matched_export(matched: DataFrame) -> DataFrame:
    return matched.select(
        *_record("crm."), F.col("crm.crm_client_id").alias("crm_client_id"), F.col("source").alias("report_source"),
        _or_blank("folio_number").alias("report_folio"), F.col("raw_row_index").alias("report_raw_row_index"),
    )


def unmatched_export(missing_in_crm: DataFrame, missing_in_report: DataFrame) -> DataFrame:
    """Unmatched rows of both sides, told apart by `record_type`."""
    blank = F.lit("")
    report = missing_in_crm.select(
        F.lit("REPORT").alias("record_type"), *_record(), blank.alias("crm_client_id"),
        F.col("source").alias("report_source"), _or_blank("folio_number").alias("report_folio"),
        _or_blank("raw_row_index").alias("report_raw_row_index"),
    )
    master = missing_in_report.select(
        F.lit("CRM").alias("record_type"), *_record(), "crm_client_id",
        blank.alias("report_source"), blank.alias("report_folio"), blank.alias("report_raw_row_index"),
    )
    return report.unionByName(master)


def write_csv(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """One folder of CSV parts per table and run."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(
            f"{folder}/csv/{name}/run_id={run_id}"
        )


def write_json(statistics: DataFrame, tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """JSON lines per table and a one-row table of statistics."""
    for name, df in {"statistics": statistics, **tables}.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/json/{name}/run_id={run_id}")


CLIENT_KEY = "pan_key"  # by which the rows of a client lie together in stored tables


def clustered(df: DataFrame, key: str) -> DataFrame:
    """Rows in ranges of a key and sorted by it, so that the files' statistics name where a key is.

    The other columns take part in the ranges: a key with a large share of the rows spans several.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
    spread = F.xxhash64(*[F.col(c) for c in plain])
    return df.repartitionByRange(F.col(key), spread).sortWithinPartitions(F.col(key), spread)


def write_tables(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Parquet per table, one partition per run. Rows with a client's key lie together, and Bloom filters
    tell the parts of a file that lack a key: a client's results read little of a table."""
    for name, df in tables.items():
        path = f"{folder}/tables/{name}/run_id={run_id}"
        if CLIENT_KEY not in df.columns:
            df.write.mode("overwrite").parquet(path)
            continue
        clustered(df, CLIENT_KEY).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{CLIENT_KEY}", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def rows_of_keys(df: DataFrame, keys: Sequence[str], column: str = CLIENT_KEY) -> DataFrame:
    """The rows whose column holds one of the keys.

    Up to a thousand keys are told to the scan, in lists of ten, the longest that Spark looks up one by
    one in a file's statistics. More are joined, over a broadcast only if they fit one.
    """
    keys = sorted(set(keys))
    if len(keys) <= 1_000:
        lists = [F.col(column).isin(keys[i : i + 10]) for i in range(0, len(keys), 10)]
        return df.filter(reduce(or_, lists, F.lit(False)))
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return attach(df, wanted, [column], "left_semi", small=fits_broadcast(wanted))


def summary_text(metrics: dict, breakdown: Iterable[tuple[str, int]]) -> str:
    """Plain-text summary from the one-row metrics and the counts per type."""
    rule, thin = "=" * 50, "-" * 50
    labels = (
        ("Total CRM Records", "total_crm_records"), ("Total Report Records", "total_report_records"),
        ("Matched Records", "matched_records"), ("Missing In CRM", "missing_in_crm"),
        ("Missing In Report", "missing_in_report"), ("Discrepancies", "field_discrepancies"),
        ("Validation Failures", "validation_failures"), ("Failed Files", "failed_files_count"),
    )
    body = [f"{label}: {metrics[key]:,}" for label, key in labels]
    types = [f" - {kind}: {count:,}" for kind, count in sorted(breakdown)] or [" - No discrepancies detected."]
    title = "        RECONCILIATION RUN EXECUTIVE SUMMARY      "
    return "\n".join([rule, title, rule, *body, "", "Discrepancy Breakdown by Type:", thin, *types, rule])


class RunHistory:
    """Table of runs in one folder, which several writers may add to.

    A run takes its number by creating a file that must not exist yet, so no two runs share one; its row
    appears, whole, once it is written under that number. The number of a writer that ends in between
    stays unused.
    """

    LAYOUT = (
        "run_no int, timestamp string, crm_filename string, report_count int,"
        " match_rate_percent double, discrepancy_count bigint, status string, result string"
    )

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def _runs(self) -> DataFrame:
        try:
            found = self._spark.read.schema(self.LAYOUT).parquet(f"{self._folder}/runs")
        except Exception as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            found = self._spark.createDataFrame([], self.LAYOUT)
        return found.withColumn("run_id", F.format_string("RUN-%03d", "run_no"))

    def _claim(self) -> int:
        """The next number, taken."""
        jvm, conf = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        claims = jvm.org.apache.hadoop.fs.Path(f"{self._folder}/claims")
        system = claims.getFileSystem(conf)
        system.mkdirs(claims)
        taken = [int(f.getPath().getName()) for f in system.listStatus(claims)]
        number = max(taken, default=0) + 1
        while True:
            try:
                system.create(jvm.org.apache.hadoop.fs.Path(claims, f"{number:09d}"), False).close()
                return number
            except Py4JJavaError as err:
                if not system.exists(jvm.org.apache.hadoop.fs.Path(claims, f"{number:09d}")):
                    raise err
                number += 1  # another writer was first

    def save(self, summary: dict, timestamp: str, crm_filename: str, report_count: int, status: str = "success") -> str:
        number = self._claim()
        row = (
            number, timestamp, crm_filename, report_count, float(summary.get("match_rate_percent", 0.0)),
            int(summary.get("discrepancy_count", 0)), status, json.dumps(summary, default=str),
        )
        rows = self._spark.createDataFrame([row], self.LAYOUT).drop("run_no")
        # a folder of its own, as writers that append to one folder delete each other's unfinished files
        rows.coalesce(1).write.parquet(f"{self._folder}/runs/run_no={number}")
        return f"RUN-{number:03d}"

    def list(self) -> DataFrame:
        """Newest first, without the payload."""
        return self._runs().orderBy(F.desc("run_no")).drop("result", "run_no")

    def get(self, run_id: str) -> DataFrame:
        return self._runs().filter(F.col("run_id") == run_id).drop("run_no")


def failed_files_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FAILED_FILE))
