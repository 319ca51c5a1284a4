"""Counts and rates of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import views
from tallyframe.operators.compare import PLACE
from tallyframe.operators.skew import attach
from tallyframe.schema import file_key


def _one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Stack tables of (name, n) and turn them into one row."""
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in names])


def _count(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")


def _counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table."""
    return _one_row([_count(name, df) for name, df in tables.items()], list(tables))


def run_statistics(
    crm: DataFrame, reports: DataFrame, matched: DataFrame, missing_in_crm: DataFrame,
    missing_in_report: DataFrame, discrepancies: DataFrame,
) -> DataFrame:
    """total_records, matched_count, unmatched_count, discrepancy_count."""
    n = _counts(crm=crm, reports=reports, matched=matched, lost_r=missing_in_crm, lost_c=missing_in_report, found=discrepancies)
    return n.select(
        (F.col("crm") + F.col("reports")).alias("total_records"),
        F.col("matched").alias("matched_count"),
        (F.col("lost_r") + F.col("lost_c")).alias("unmatched_count"),
        F.col("found").alias("discrepancy_count"),
    )


def summary_metrics(
    crm: DataFrame, reports: DataFrame, matched: DataFrame, discrepancies: DataFrame,
    dlq: DataFrame | None = None, failed_files: DataFrame | None = None,
) -> DataFrame:
    """Headline counts in one row; every type that is not "missing" is a field discrepancy."""
    tables = {"total_crm_records": crm, "total_report_records": reports, "matched_records": matched}
    if dlq is not None:
        tables["validation_failures"] = dlq
    if failed_files is not None:
        tables["failed_files_count"] = failed_files
    kind = F.col("discrepancy_type")
    group = (
        F.when(kind == "MISSING_IN_CRM", "missing_in_crm").when(kind == "MISSING_IN_REPORT", "missing_in_report")
        .otherwise("field_discrepancies")
    )
    parts = [_count(name, df) for name, df in tables.items()]
    parts.append(discrepancies.groupBy(group.alias("name")).agg(F.count(F.lit(1)).alias("n")))
    names = ["total_crm_records", "total_report_records", "matched_records", "missing_in_crm", "missing_in_report",
             "field_discrepancies", "validation_failures", "failed_files_count"]
    row = _one_row(parts, names)
    return row.select(*[F.coalesce(name, F.lit(0)).alias(name) for name in names])


def breakdown_by_type(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.groupBy("discrepancy_type").agg(F.count(F.lit(1)).alias("count")).orderBy("discrepancy_type")


def source_breakdown(aligned: DataFrame, discrepancies: DataFrame, approximate: bool = False) -> DataFrame:
    """Per source: rows processed, rows matched and distinct PANs with a discrepancy."""
    distinct = F.approx_count_distinct("pan") if approximate else F.count_distinct("pan")
    rows = aligned.groupBy("source").agg(
        F.count(F.lit(1)).alias("processed"), F.count(F.when(F.col("match_route") != "UNMATCHED", 1)).alias("matched")
    )
    wrong = discrepancies.filter(F.col("source") != "CRM").groupBy("source").agg(distinct.alias("discrepancies"))
    return rows.join(wrong, "source", "left").select(
        "source", "processed", "matched", F.coalesce("discrepancies", F.lit(0)).alias("discrepancies")
    )


def source_sketches(aligned: DataFrame, discrepancies: DataFrame, lg_entries: int = 14) -> DataFrame:
    """Per source and file: rows processed, rows matched and a sketch of the PANs with a discrepancy.

    Sketches of several files or runs add up without their rows, see `merged_breakdown`. With 2 **
    `lg_entries` entries the count of distinct PANs is off by 0.83 / sqrt(entries) in the standard
    deviation, 0.65 % with 14.
    """
    by = ["source", "file"]
    rows = aligned.withColumn("file", file_key(aligned)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"), F.count(F.when(F.col("match_route") != "UNMATCHED", 1)).alias("matched"))
    wrong = discrepancies.filter(F.col("source") != "CRM").withColumn("file", file_key(discrepancies))
    return rows.join(wrong.groupBy(*by).agg(F.hll_sketch_agg("pan", F.lit(lg_entries)).alias("pans")), by, "left")


def merged_breakdown(sketches: DataFrame) -> DataFrame:
    """`source_breakdown` over all files and runs whose `source_sketches` are given; a client that differs
    in several of them counts once."""
    return sketches.groupBy("source").agg(
        F.sum("processed").alias("processed"), F.sum("matched").alias("matched"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("pans", F.lit(True))), F.lit(0)).alias("discrepancies"))


def source_match_rate(breakdown: DataFrame) -> DataFrame:
    """Share of matched rows per source, and its band."""
    rate = F.when(F.col("processed") > 0, F.col("matched") / F.col("processed") * 100).otherwise(100.0)
    return breakdown.withColumn("match_rate", rate).withColumn(
        "band", F.when(rate >= 95, "good").when(rate >= 80, "fair").otherwise("poor")
    )


def match_rate(crm: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Share of master rows not missing in the reports, in percent with one decimal."""
    n = _counts(total_crm_records=crm, lost=discrepancies.filter("discrepancy_type = 'MISSING_IN_REPORT'"))
    kept = F.greatest(F.lit(0), F.col("total_crm_records") - F.col("lost"))
    return n.select(
        "total_crm_records",
        kept.alias("matched_records"),
        F.when(F.col("total_crm_records") > 0, F.bround(kept / F.col("total_crm_records") * 100, 1))
        .otherwise(100.0).alias("match_rate_percent"),
    )


def validation_counts(checked: DataFrame, survivors: DataFrame, by: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """Per file: rows, rows valid after de-duplication, rows invalid, and duplicates among those.

    `checked` carries `failures`; `survivors` are the rows left after de-duplication.
    """
    totals = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"), F.count(F.when(F.size("failures") == 0, 1)).alias("_passed")
    )
    kept = survivors.groupBy(*by).agg(F.count(F.lit(1)).alias("_kept"))
    valid = F.coalesce("_kept", F.lit(0))
    return totals.join(kept, list(by), "left").select(
        *by, "total_records", valid.alias("valid_records"),
        (F.col("total_records") - valid).alias("invalid_records"),
        (F.col("_passed") - valid).alias("duplicate_records"),
    )


def parse_counts(parsed: DataFrame, by: tuple[str, ...] = ("file_id", "file_name")) -> DataFrame:
    """Per file: rows read, accepted and rejected. `parsed` carries `reasons`."""
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.size("reasons") == 0, 1)).alias("parsed_rows"),
        F.count(F.when(F.size("reasons") > 0, 1)).alias("failed_rows"),
    )


def clean_sources(matched: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """(pan, source_label) of clients whose matched rows there carry no discrepancy, in first-seen
    order of the file rows."""
    row = ["_file", "raw_row_index"]
    wrong = discrepancies.filter("phase = 0").select(file_key(discrepancies).alias("_file"), "raw_row_index").distinct()
    rows = matched.filter(F.col("match_route") != "UNMATCHED").withColumn("_file", file_key(matched))
    clean = attach(rows, wrong, row, "left_anti")
    label = F.concat(views.source_label(F.col("source")), views.code_suffix(F.col("folio_number")))
    return clean.groupBy(F.col("crm.pan").alias("pan"), label.alias("source_label")).agg(
        F.min(F.struct("file_name", "_file", "raw_row_index")).alias("first_seen")
    ).select("pan", "source_label", "first_seen.file_name", "first_seen.raw_row_index")


def key_issues(discrepancies: DataFrame) -> DataFrame:
    """Distinct issues of severity CRITICAL, HIGH or MEDIUM, with where each was seen first."""
    where = F.coalesce(views.discrepancy_column(), F.lit("External source"))
    text = (
        F.when(F.col("discrepancy_type") == "DUPLICATE_RECORD", F.concat(F.lit("Duplicate record found in "), where))
        .when(F.col("discrepancy_type") == "MISSING_IN_CRM",
              F.concat(F.lit("Record present in "), where, F.lit(" but missing in CRM")))
        .when(F.col("discrepancy_type") == "MISSING_IN_REPORT",
              F.concat(F.lit("Record present in CRM but missing in "), where))
        .otherwise(F.concat(views.field_label(F.col("field_name")), F.lit(" for "), where, F.lit(" does not match CRM")))
    )
    return (
        discrepancies.filter(F.upper("severity").isin("CRITICAL", "HIGH", "MEDIUM"))
        .groupBy(text.alias("issue"))
        .agg(F.min(F.struct(*PLACE)).alias("first_seen"), F.count(F.lit(1)).alias("occurrences"))
    )
