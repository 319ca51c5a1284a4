"""Field comparison, explanations, severities and audit columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT_COMPARE_PROFILE, Profiles, ReconConfig, SourceProfile
from tallyframe.functions.text import fixed_two, lookup
from tallyframe.operators.match import is_incomplete
from tallyframe.schema import (
    AMOUNT,
    COMPARABLE,
    DISCREPANCY,
    RECONCILER_VERSION,
    STANDARD_FIELDS,
    skipped_note,
)

# Severities of types the configuration does not mention; the rest are HIGH.
DEFAULT_SEVERITY = {
    "MISSING_IN_CRM": "CRITICAL",
    "FIELD_MISSING": "MEDIUM",
    "FIELD_EMPTY": "MEDIUM",
    "INCOMPLETE_CRM_RECORD": "MEDIUM",
    "FUZZY_MATCH_WARNING": "MEDIUM",
}


def compare_profiles(config: ReconConfig) -> Profiles:
    return Profiles(config.sources, DEFAULT_COMPARE_PROFILE)


def severity(config: ReconConfig, discrepancy_type: Column) -> Column:
    known = {**DEFAULT_SEVERITY, **config.reporting.severity_mappings}
    return F.coalesce(lookup(discrepancy_type, known), F.lit("HIGH"))


def amount_differs(a: Column, b: Column, epsilon: float) -> Column:
    """More than `epsilon` apart, in exact decimals; null counts as zero."""
    zero = F.lit(0).cast(AMOUNT)
    limit = F.lit(Decimal(str(epsilon)))
    return F.abs(F.coalesce(a, zero) - F.coalesce(b, zero)) > limit


def date_differs(a: Column, b: Column, days: int) -> Column:
    """More than `days` apart, or present on one side only."""
    apart = F.abs(F.datediff(a, b)) > days
    return F.coalesce(apart, a.isNull() != b.isNull())


def _differs(field: str, config: ReconConfig) -> Column:
    a, b = F.col(f"crm.{field}"), F.col(field)
    if field == "total_amount":
        return amount_differs(a, b, config.engine.amount_epsilon)
    if field == "last_transaction_date":
        return date_differs(a, b, config.engine.date_days_tolerance)
    return ~a.eqNullSafe(b)


def _differing_fields(config: ReconConfig) -> tuple[dict[str, Column], Column]:
    """Helper columns per field, `_<field>` (the pair differs) and `_crm_<field>` (text of the master
    value), and the array of (field_no, discrepancy_type, field_name, crm_value, report_value)
    built from them.

    A column the file lacks is named first, then a blank cell, then differing values. Amounts
    show the digits they were written with. The array uses flat columns only: Spark mixes up the
    columns it keeps when it also takes struct fields out from under an exploding step.
    """
    helpers, entries = {}, []
    for order, (field, naming) in enumerate(COMPARABLE.items()):
        shown = "coalesce({0}total_amount_text, CAST({0}total_amount AS STRING))" if field == "total_amount" else (
            f"CAST({{0}}{field} AS STRING)"
        )
        helpers[f"_{field}"] = _differs(field, config)
        helpers[f"_crm_{field}"] = F.expr(shown.format("crm."))
        kind = f"CASE WHEN _{field} THEN '{naming.code}_MISMATCH' END"
        if field in STANDARD_FIELDS:
            kind = (
                f"CASE WHEN array_contains(missing_fields, '{field}') THEN 'FIELD_MISSING'"
                f" WHEN array_contains(empty_fields, '{field}') THEN 'FIELD_EMPTY' ELSE {kind} END"
            )
        entries.append(_entry(order, kind, field, f"_crm_{field}", shown.format("")))
    return helpers, F.expr(
        f"filter(array({', '.join(entries)}),"
        " d -> d.discrepancy_type IS NOT NULL AND array_contains(_listed, d.field_name))"
    )


def _entry(order: int, kind: str, field: str | None = None, a: str = "NULL", b: str = "NULL") -> str:
    name = f"'{field}'" if field else "NULL"
    return (
        f"named_struct('field_no', {order}, 'discrepancy_type', {kind}, 'field_name', CAST({name} AS STRING),"
        f" 'crm_value', CAST({a} AS STRING), 'report_value', CAST({b} AS STRING))"
    )


def explanation(config: ReconConfig) -> Column:
    """Explanation of an exploded discrepancy.

    Works on the columns discrepancy_type, field_name, crm_value, report_value, source, pan,
    folio_number, match_route and match_confidence. Nulls read `None`.
    """
    def col(name: str) -> str:
        return f"coalesce({name}, 'None')"

    crm, report = col("crm_value"), col("report_value")
    labels = ", ".join(f"'{f}', '{c.label}'" for f, c in COMPARABLE.items())
    label = f"map({labels})[field_name]"
    crm_number, report_number = fixed_two("try_cast(crm_value AS DOUBLE)"), fixed_two("try_cast(report_value AS DOUBLE)")
    return F.expr(f"""
        CASE discrepancy_type
        WHEN 'MISSING_IN_CRM' THEN
          concat("Record with PAN '", {col('pan')}, "' and Folio '", {col('folio_number')}, "' is missing in CRM database.")
        WHEN 'FUZZY_MATCH_WARNING' THEN
          concat('Fuzzy match warning: Record aligned via name similarity of ',
                 format_string('%.1f', match_confidence * 100), "% using route '", match_route, "'.")
        WHEN 'FIELD_MISSING' THEN
          concat({label}, ' column missing from ', source, " source file. CRM value '", {crm}, "' could not be compared.")
        WHEN 'FIELD_EMPTY' THEN
          concat({label}, ' column exists in ', source, " but value is blank/empty. CRM value '", {crm},
                 "' could not be compared.")
        WHEN 'DATE_MISMATCH' THEN
          concat("Transaction date mismatch detected: CRM value '", {crm}, "' differs from Report value '", {report},
                 "' beyond configured tolerance of {config.engine.date_days_tolerance} days.")
        ELSE
          CASE WHEN discrepancy_type = 'AMOUNT_MISMATCH' AND try_cast(crm_value AS DOUBLE) IS NOT NULL
                    AND try_cast(report_value AS DOUBLE) IS NOT NULL
          THEN concat('Amount mismatch detected. CRM value ', {crm_number}, ' differs from Report value ', {report_number}, '.')
          ELSE concat(initcap(replace(field_name, '_', ' ')), " mismatch detected. CRM value '", {crm},
                      "' differs from Report value '", {report}, "'.") END
        END
    """)


def skipped_notes(config: ReconConfig, fields: tuple[str, ...] = tuple(COMPARABLE)) -> Column:
    """Notes on the `fields` the row's source does not compare."""

    def notes(profile: SourceProfile) -> Column:
        listed = {c.strip().lower() for c in profile.compare}
        names = ", ".join(repr(skipped_note(f)) for f in fields if f not in listed)
        return F.expr(f"array({names})").cast("array<string>")

    return compare_profiles(config).by_source(notes)


def _trace(route: Column, confidence: Column, run_ts: str, rule: Column, notes: Column) -> Column:
    return F.struct(
        route.alias("matching_route"),
        confidence.alias("match_confidence"),
        F.lit(run_ts).alias("evaluation_timestamp"),
        F.lit(RECONCILER_VERSION).alias("reconciler_version"),
        rule.alias("rule_evaluated"),
        notes.alias("skipped_comparisons"),
    )


# Columns that place a discrepancy: reports first, then master rows, each in file order.
PLACE = ("phase", "file_id", "file_name", "file_path", "raw_row_index", "folio_number", "field_no", "crm_client_id")


def report_discrepancies(
    aligned: DataFrame, config: ReconConfig, run_ts: str = "", which: tuple[str, ...] = ("field", "fuzzy", "unmatched")
) -> DataFrame:
    """Discrepancies of report rows: differing fields, fuzzy warnings and rows missing in the CRM.

    All of them come from one pass over the aligned rows.
    """
    none = f"filter(array({_entry(0, 'NULL')}), d -> false)"
    warning = f"array({_entry(len(COMPARABLE), repr('FUZZY_MATCH_WARNING'))})" if "fuzzy" in which else none
    unmatched = f"array({_entry(0, repr('MISSING_IN_CRM'))})" if "unmatched" in which else none
    helpers, differing = _differing_fields(config) if "field" in which else ({}, F.expr(none))
    entries = (
        F.when(F.col("match_route") == "UNMATCHED", F.expr(unmatched))
        .when(F.col("match_route").startswith("FUZZY"), F.concat(differing, F.expr(warning)))
        .otherwise(differing)
    )
    listed = compare_profiles(config).by_source(
        lambda p: F.expr(f"array({', '.join(repr(f.strip().lower()) for f in p.compare)})").cast("array<string>")
    )
    flat = aligned.withColumns({**helpers, "_listed": listed, "crm_client_id": F.col("crm.crm_client_id")}).drop("crm")
    found = flat.select(
        "pan", "source", "file_id", "file_name", "file_path", "raw_row_index", "folio_number", "match_route", "match_confidence",
        "crm_client_id", F.inline(entries),
    )
    info = F.expr(
        "map('file_name', coalesce(file_name, 'N/A'), 'file_id', coalesce(file_id, 'N/A'),"
        " 'raw_row_index', CAST(raw_row_index AS STRING),"
        " 'folio_number', coalesce(nullif(folio_number, ''), 'N/A'))"
    )
    no_notes = F.array().cast("array<string>")
    notes = F.when(F.col("field_name").isNotNull(), skipped_notes(config)).otherwise(no_notes)
    rule = F.concat(F.lit("SourceProfile: "), F.col("source"))
    return found.select(
        "discrepancy_type", "pan", "field_name", "crm_value", "report_value",
        severity(config, F.col("discrepancy_type")).alias("severity"),
        explanation(config).alias("explanation"), "source", info.alias("source_info"),
        _trace(F.col("match_route"), F.col("match_confidence"), run_ts, rule, notes).alias("audit_trace"),
        F.lit(0).alias("phase"), "file_id", "file_name", "file_path", "raw_row_index", "folio_number", "field_no", "crm_client_id",
    )


def master_discrepancies(missing: DataFrame, config: ReconConfig, run_ts: str = "") -> DataFrame:
    """Discrepancies of master rows that no report row matched."""
    relabel = config.validation.suppress_missing_in_report_for_incomplete_crm
    kind = F.when(is_incomplete() & F.lit(relabel), "INCOMPLETE_CRM_RECORD").otherwise("MISSING_IN_REPORT")
    why = F.expr("""
        concat("Client ID '", coalesce(crm_client_id, 'None'), "' with PAN '", coalesce(pan, 'None'), "' is ")
    """)
    why = F.when(
        kind == "INCOMPLETE_CRM_RECORD",
        F.concat(F.lit("CRM Record "), why,
                 F.lit("incomplete (missing contact info: mobile/email, and compliance status: KYC/FATCA)"
                       " and is not present in processed reports.")),
    ).otherwise(F.concat(F.lit("CRM "), why, F.lit("missing in the processed report files.")))
    none = F.lit(None).cast("string")
    no_notes = F.array().cast("array<string>")
    return missing.select(
        kind.alias("discrepancy_type"), "pan", none.alias("field_name"), none.alias("crm_value"),
        none.alias("report_value"), severity(config, kind).alias("severity"), why.alias("explanation"),
        F.lit("CRM").alias("source"), F.expr("map('crm_client_id', crm_client_id)").alias("source_info"),
        _trace(F.lit("UNMATCHED"), F.lit(0.0), run_ts, F.lit("CRM Master List"), no_notes).alias("audit_trace"),
        F.lit(1).alias("phase"), none.alias("file_id"), none.alias("file_name"), none.alias("file_path"),
        F.col("crm_order").cast("bigint").alias("raw_row_index"), none.alias("folio_number"),
        F.lit(0).alias("field_no"), "crm_client_id",
    )


def matched_audits(matched: DataFrame, config: ReconConfig, run_ts: str = "") -> DataFrame:
    """One audit row per matched report row."""
    return matched.select(
        "pan",
        F.col("match_route").alias("route"),
        F.col("match_confidence").alias("confidence"),
        "source",
        F.lit(run_ts).alias("timestamp"),
        skipped_notes(config, STANDARD_FIELDS).alias("skipped_comparisons"),
        "file_id", "file_name", "file_path", "raw_row_index",
    )


def public(discrepancies: DataFrame) -> DataFrame:
    """The documented columns, without the placing helpers."""
    return discrepancies.select(*DISCREPANCY)
