"""A whole run: files in, result tables out."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT_CRM_PROFILE, DEFAULT_REPORT_PROFILE, Profiles, ReconConfig
from tallyframe.errors import FileAccessError, ParserError, SchemaMismatchError
from tallyframe.operators import metrics, views
from tallyframe.operators.dedup import dedup_first, duplicates
from tallyframe.operators.normalize import normalize, split_normalized
from tallyframe.operators.parse import parse_table, split_columns, split_parsed
from tallyframe.operators.skew import DEFAULT_POLICY, SkewPolicy
from tallyframe.operators.validate import explode_failures, split_valid, with_failures
from tallyframe.plans.reconcile import Reconciliation, reconcile
from tallyframe.schema import DLQ, REPORT, conform, struct_type
from tallyframe.sources import catalog, files, sinks, statements, workbook
from tallyframe.sources.ordered import PLACE, OrderedTable
from tallyframe.sources.textindex import TextIndex
from tallyframe.storage import written


@dataclass
class Prepared:
    """Parsed, normalised, validated and de-duplicated rows of one side, and what fell out."""

    parsed: DataFrame
    checked: DataFrame
    duplicates: DataFrame
    valid: DataFrame
    dlq: DataFrame


@dataclass
class RunResult:
    run_id: str
    crm: Prepared
    reports: Prepared
    result: Reconciliation
    dlq: DataFrame
    failed_files: DataFrame
    metadata: DataFrame
    summary: DataFrame
    outputs: list[str] = field(default_factory=list)


def prepare(
    parsed: DataFrame, kind: str, config: ReconConfig, keep_extended: bool = True,
    cut: Callable[[DataFrame], DataFrame] = written,
) -> Prepared:
    """Everything between parsing and matching. `kind` is "crm" or "report"."""
    parsed = cut(parsed if kind == "report" else parsed.withColumn("source", F.lit("CRM")))
    accepted, rejected = split_parsed(parsed)
    # the many patterns of normalisation and of the rules are evaluated once per row
    normal = cut(normalize(accepted, keep_extended))
    good, refused = split_normalized(normal)
    if kind == "crm":
        profiles = Profiles({"CRM": config.sources.get("CRM", DEFAULT_CRM_PROFILE)}, DEFAULT_CRM_PROFILE)
    else:
        profiles = Profiles(config.sources, DEFAULT_REPORT_PROFILE)
    checked = cut(with_failures(good, profiles, config.validation))
    passed, failed = split_valid(checked)
    copies = duplicates(passed, kind)
    valid = cut(dedup_first(passed, kind))

    def dead(df: DataFrame, stage: str, failure, name, message) -> DataFrame:
        return df.select(
            F.lit(stage).alias("stage"), "file_name", "source", "row_number", failure.alias("failure_type"),
            name.alias("field_name"), message.alias("message"), "raw_data",
        )

    none = F.lit(None).cast("string")
    dlq = reduce(DataFrame.unionByName, [
        dead(rejected, "parse", F.lit("PARSE_ERROR"), none, F.col("reason")),
        dead(refused, "normalize", F.lit("NORMALIZATION_ERROR"), F.lit("pan"),
             F.concat(F.lit("Normalization failed: "), F.col("norm_error"))),
        dead(explode_failures(failed), "validate", F.col("failure_type"), F.col("field_name"), F.col("message")),
        dead(copies, "duplicate", F.col("failure_type"), F.lit("pan"), F.col("message")),
    ])
    return Prepared(parsed, checked, copies, valid, dlq.select(*DLQ))


def _read(
    spark: SparkSession, probe: Row, group: Sequence[str], source: str, header: list[str], books, sheet: str | None
) -> DataFrame:
    if probe.zipped:
        raw = workbook.scan_workbook(books, group, header, sheet)
    else:
        raw = files.scan_csv(spark, group, header)
    return parse_table(raw, source, headers=header)


def _read_special(spark: SparkSession, reader: catalog.Reader, paths: list[str]) -> DataFrame:
    """Parsed rows of the files of a registered source that brings its own format."""
    spark.dataSource.register(reader.data_source)
    raw = spark.read.format(reader.data_source.name()).option("paths", json.dumps(paths)).load()
    missing = {"_row", "_file_path"} - set(raw.columns)
    if missing:
        raise SchemaMismatchError(f"The data source of {reader.source} lacks columns: {', '.join(sorted(missing))}")
    cells = [F.col(c).cast("string").alias(c) for c in raw.columns if c not in ("_row", "_file_path")]
    return parse_table(raw.select(*cells, "_row", *files.place(F.col("_file_path"))), reader.source)


def _workbooks(
    spark: SparkSession, probes: Sequence[Row], cut, sheet: str | None
) -> tuple[DataFrame | None, dict[str, Row]]:
    """Rows of all workbooks, and their summaries by the path that was given."""
    zipped = [p.path for p in probes if p.zipped]
    if not zipped:
        return None, {}
    rows = cut(workbook.workbook_rows(spark, zipped))
    found = {_plain(r.path): r for r in workbook.sheet_summary(rows, sheet).collect()}
    # the scan names a file by its full path, the caller perhaps by a relative one or without a scheme
    out = {}
    for path in zipped:
        hits = [r for k, r in found.items() if k == _plain(path) or k.endswith("/" + _plain(path).removeprefix("./"))]
        out[path] = min(hits, key=lambda r: len(r.path)) if hits else None
    return rows, out


def _plain(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path.rstrip("/"))


def load_crm(
    spark: SparkSession, path: str, cut: Callable[[DataFrame], DataFrame] = written, sheet: str | None = None
) -> DataFrame:
    """Parsed master file; any problem with the file itself is fatal. `sheet` names a workbook's sheet."""
    probe = files.probe(spark, [path]).first()
    if not probe.readable:
        raise FileAccessError(f"CRM master file does not exist: {path}")
    if probe.size_seen == 0:
        raise ParserError(f"CRM file is empty: {probe.file_name}")
    suffix = "." + probe.file_name.rsplit(".", 1)[-1].lower()
    if suffix not in (".csv", ".xlsx", ".xls"):
        raise ParserError(f"Unsupported file type: {suffix}")
    books, info = _workbooks(spark, [probe], cut, sheet)
    if probe.zipped:  # also a workbook that is named .csv
        summary = info[path]
        if summary is None or not summary.header and not summary.error:
            raise ParserError(f"CRM file is empty: {probe.file_name}")
        if summary.error:
            raise ParserError(f"Failed to load Excel file structure: {summary.error}")
        header, group = [str(h).strip() for h in summary.header], [summary.path]
    elif suffix != ".csv":
        raise ParserError(f"Failed to load Excel file structure: {probe.file_name}")
    else:
        header, group = files.split_header(probe.header_line), [path]
    return _read(spark, probe, group, "CRM", header, books, sheet)


def load_reports(
    spark: SparkSession, paths: Sequence[str], cut: Callable[[DataFrame], DataFrame] = written, sheet: str | None = None
) -> tuple[DataFrame, list[tuple]]:
    """Parsed rows of all report files, and (file_name, source, failure_type, message) of the files
    that cannot be used. Files with the same source and header are read by one scan."""
    probes = files.probe(spark, paths).collect() if paths else []
    gone = [p.path for p in probes if not p.readable]
    if gone:
        raise FileAccessError(f"Report file does not exist: {gone[0]}")
    books, info = _workbooks(spark, probes, cut, sheet)

    failed: list[tuple] = []
    facts = []
    special: dict[catalog.Reader, list[str]] = {}
    for p in probes:
        if reader := catalog.reader_of(p.file_name):
            special.setdefault(reader, []).append(p.path)
            continue
        summary = info.get(p.path)
        names = p.file_name.lower()
        if names.endswith(".csv") and (p.zipped or p.size_seen == 0 or not p.header_line):
            why = "not delimited text" if p.zipped else "No columns to parse from file"
            failed.append((p.file_name, "UNKNOWN", "PARSER_DETECTION_ERROR",
                           f"Parser auto-detection failed for file {p.file_name}: {why}"))
        elif names.endswith((".xlsx", ".xls")) and (not p.zipped or summary.error):
            why = summary.error if summary else "not a zipped workbook"
            failed.append((p.file_name, "UNKNOWN", "PARSER_DETECTION_ERROR",
                           f"Parser auto-detection failed for file {p.file_name}: {why}"))
        else:
            header = [str(h).strip() for h in summary.header] if summary else files.split_header(p.header_line or "")
            facts.append((p.path, p.file_name, header, list(summary.sheets) if summary else []))
    layout = "path string, file_name string, header array<string>, sheets array<string>"
    detected = spark.createDataFrame(facts, layout).select(
        "path", "file_name", "header",
        catalog.detect_source(F.col("file_name"), F.col("header"), F.col("sheets")).alias("source"),
        catalog.detection_failure(F.col("file_name")).alias("failure"),
    ).collect() if facts else []

    by_path = {p.path: p for p in probes}
    groups: dict[tuple, list[str]] = {}
    texts = []
    for d in detected:
        p = by_path[d.path]
        if d.source is None:
            failed.append((d.file_name, "UNKNOWN", "PARSER_DETECTION_ERROR", d.failure))
        elif d.source == "PDF_CAS":
            if p.size_seen == 0:
                failed.append((d.file_name, d.source, "PARSER_ERROR", f"PDF CAS file is empty: {d.file_name}"))
            elif (p.header_line or "").startswith("%PDF"):
                failed.append((d.file_name, d.source, "PARSER_ERROR", f"Failed to read PDF structure: {d.file_name}"))
            else:
                texts.append(d.path)
        else:
            try:
                found = dict.fromkeys(d.header, F.lit(""))
                catalog.map_headers([*found, *split_columns(found)], catalog.aliases_of(d.source))
                groups.setdefault((d.source, p.zipped, tuple(d.header)), []).append(d.path)
            except SchemaMismatchError as err:
                failed.append((d.file_name, d.source, "PARSER_ERROR", str(err)))
    parts = [_read_special(spark, reader, named) for reader, named in special.items()]
    for (source, _, header), group in groups.items():
        members = [info[g].path for g in group] if by_path[group[0]].zipped else group
        parts.append(_read(spark, by_path[group[0]], members, source, list(header), books, sheet))
    if texts:
        name, parent, path = files.place(F.col("_path"))
        parts.append(statements.parse_statements(files.numbered_lines(spark, texts).select(
            name.alias("file_name"), parent.alias("file_id"), path.alias("file_path"), "line_no", "line")))
    if not parts:
        empty = struct_type(REPORT).simpleString()[len("struct<"):-1]
        parts = [spark.createDataFrame([], f"struct<{empty},row_number:bigint,raw_data:map<string,string>,reasons:array<string>>")]
    return reduce(DataFrame.unionByName, parts), failed


def run(
    spark: SparkSession,
    crm_path: str,
    report_paths: Sequence[str],
    config: ReconConfig,
    run_id: str | None = None,
    run_ts: str = "",
    keep_extended: bool = True,
    policy: SkewPolicy = DEFAULT_POLICY,
    write: bool = True,
    cut: Callable[[DataFrame], DataFrame] = written,
    sheet: str | None = None,
) -> RunResult:
    """Reconcile report files against a master file and write the configured outputs.

    `sheet` names the sheet to read in workbooks, else it is the first one.
    """
    run_id = run_id or str(uuid.uuid4())
    crm_path, report_paths = str(crm_path), [str(p) for p in report_paths]
    # hashed first, so that the hashes are of what is then read; a row per named file
    marks = {m.path: m for m in files.fingerprint_readable(spark, [crm_path, *report_paths]).collect()}
    crm = prepare(load_crm(spark, crm_path, cut, sheet), "crm", config, keep_extended, cut)
    parsed, failures = load_reports(spark, report_paths, cut, sheet)
    reports = prepare(parsed, "report", config, keep_extended, cut)
    result = reconcile(crm.valid, conform(reports.valid, REPORT), config, run_ts, policy, cut)
    if write:  # counts, tables and exports all read them
        result = replace(result, discrepancies=written(result.discrepancies), missing_in_report=written(result.missing_in_report))
    dlq = cut(crm.dlq.unionByName(reports.dlq))
    failed_files = sinks.failed_files_table(spark, failures)
    summary = metrics.summary_metrics(crm.parsed, reports.parsed, result.matched, result.discrepancies, dlq, failed_files)

    named = [m.file_name for p, m in marks.items() if p in report_paths]
    hashes = [F.lit(x) for p in dict.fromkeys(report_paths)
              for x in (marks[p].file_name if named.count(marks[p].file_name) == 1 else p, marks[p].sha256)]
    metadata = summary.select(
        F.lit(run_id).alias("run_id"), F.lit(run_ts).alias("timestamp"),
        F.lit(marks[crm_path].sha256).alias("crm_file_hash"),
        F.create_map(*hashes).cast("map<string,string>").alias("report_file_hashes"),
        "total_crm_records", "total_report_records",
        F.col("validation_failures").alias("validation_failures_count"),
        (F.col("missing_in_crm") + F.col("missing_in_report") + F.col("field_discrepancies")).alias("discrepancies_count"),
        "failed_files_count",
    )
    out = RunResult(run_id, crm, reports, result, dlq, failed_files, metadata, summary)
    if write:
        out.outputs = write_outputs(out, config)
    return out


def write_outputs(out: RunResult, config: ReconConfig) -> list[str]:
    """Result tables as Parquet, plus the configured formats. Returns the formats written. The discrepancies
    are read several times and should be stored.

    All views are computed from clear values; each table is masked as its last step.
    """
    found, audits = out.result.discrepancies, out.result.matched_audits
    secret = config.reporting.redact_sensitive_fields
    folder, formats = str(config.output_directory), sinks.output_formats(config)

    def shown(df: DataFrame) -> DataFrame:
        return views.redact(df) if secret else df

    def keyed(df: DataFrame) -> DataFrame:
        """With the keyed hash by which a client's rows are found."""
        pan = F.col("pan") if "pan" in df.columns else F.col("crm.pan") if "crm" in df.columns else None
        return shown(df if pan is None else df.withColumn("pan_key", views.pan_key(pan, config.reporting.redaction_key)))

    def exported(df: DataFrame) -> DataFrame:
        """Exports carry identifiers under other names as well."""
        return df.select(*[views.masked_export(c, df) for c in df.columns]) if secret else df

    tables = {
        "discrepancies": found, "matched_audits": audits, "aligned": out.result.aligned,
        "missing_in_report": out.result.missing_in_report, "dlq": out.dlq, "failed_files": out.failed_files,
        "parse_counts": metrics.parse_counts(out.reports.parsed, ("file_path", "file_id", "file_name")),
        "validation_counts": metrics.validation_counts(
            out.reports.checked, out.reports.valid, ("file_path", "file_id", "file_name")),
        "source_sketches": metrics.source_sketches(out.result.aligned, found),
    }
    sinks.write_tables({name: keyed(df) for name, df in tables.items()}, folder, out.run_id)
    if "csv" in formats:
        sinks.write_csv({name: exported(df) for name, df in {
            "discrepancies": sinks.discrepancy_export(found),
            "matched": sinks.matched_export(out.result.matched),
            "unmatched": sinks.unmatched_export(out.result.missing_in_crm, out.result.missing_in_report),
            "failed_files": out.failed_files,
        }.items()}, folder, out.run_id)
    if "json" in formats:
        sinks.write_json(out.summary, {
            "discrepancies": shown(found.drop("phase", "field_no")), "failed_files": out.failed_files,
            "matched_audits": shown(audits),
        }, folder, out.run_id)
    if "excel" in formats or "xlsx" in formats:
        copies = out.reports.duplicates
        sheets = {
            "reconciliation": views.field_matrix_long(out.result.aligned, config),
            "errors_actions": views.action_list(found, copies),
            "key_issues": metrics.key_issues(found).select("issue", "occurrences"),
            "clean_sources": metrics.clean_sources(out.result.matched, found),
        }
        sinks.write_csv({f"sheets/{name}": exported(df) for name, df in sheets.items()}, folder, out.run_id)
    return formats


def stored_client(
    spark: SparkSession, folder: str, run_id: str, pans: Sequence[str], table: str = "discrepancies", key: str = ""
) -> DataFrame:
    """The rows of some clients in a table of a stored run, masked or not. `key`: the run's `redaction_key`."""
    rows = spark.read.parquet(f"{folder}/tables/{table}/run_id={run_id}")
    return sinks.rows_of_keys(rows, [views.pan_key_text(p, key) for p in pans if p.strip()])


def stored_breakdown(spark: SparkSession, folder: str, run_ids: Sequence[str]) -> DataFrame:
    """Rows, matches and distinct clients with a discrepancy per source over several stored runs."""
    paths = [f"{folder}/tables/source_sketches/run_id={r}" for r in run_ids]
    return metrics.merged_breakdown(spark.read.parquet(*paths))


def stored_order(
    spark: SparkSession, folder: str, run_id: str, by: str = "severity", ascending: bool = False
) -> OrderedTable:
    """The discrepancies of a stored run in an order, made when it is first asked for."""
    way = "up" if ascending else "down"
    found = spark.read.parquet(f"{folder}/tables/discrepancies/run_id={run_id}")
    return OrderedTable.write(found, views.page_order(by, ascending), f"{folder}/orders/discrepancies/{by}-{way}/run_id={run_id}")


def stored_page(
    spark: SparkSession, folder: str, run_id: str, by: str = "severity", ascending: bool = False, number: int = 1, size: int = 10
) -> DataFrame:
    """A page of the sorted discrepancies of a stored run; a late page costs what the first one does."""
    return stored_order(spark, folder, run_id, by, ascending).page(number, size).drop(*PLACE)


def stored_search(
    spark: SparkSession, folder: str, run_id: str, text: str = "", severity: str = "ALL", source: str = "ALL"
) -> DataFrame:
    """Discrepancies of a stored run whose PAN or explanation holds a text, found by an index that is made
    when it is first asked for. Of a masked run the masked texts are searched."""
    table = stored_order(spark, folder, run_id)
    index = TextIndex.write(table, ("pan", "explanation"), f"{folder}/indexes/discrepancies/run_id={run_id}")
    return views.search(index.search(text) if text else table.rows, text, severity, source).drop(*PLACE)
