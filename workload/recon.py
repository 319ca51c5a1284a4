"""Queries over matching, comparison, metrics, views and exports."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.config import Matching, standard_config
from tallyframe.functions.similarity import sorted_name_score
from tallyframe.functions.text import token_sort
from tallyframe.operators import compare, match, metrics, views
from tallyframe.operators.skew import attach
from tallyframe.plans.reconcile import reconcile
from tallyframe.schema import CRM, REPORT, conform
from tallyframe.sources import sinks, statements
from tallyframe.storage import scratch_folder
from workload.fields import BASE, COPIES, derive
from workload.inputs import crm_table, report_table, table
from workload.registry import query

CONFIG = standard_config()
EXACT_ONLY = replace(CONFIG, matching=Matching())

# Oracle of the whole dataflow. Names differ by one more token at most, so the similarity has a
# closed form: 200 n / (2 n + 2) with n the length of the shorter name.
FLOW = f"""{BASE},
first_crm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pan ORDER BY crm_order) AS n FROM crm) WHERE n = 1),
exact AS (SELECT r.*, c.crm_order AS hit FROM rep r LEFT JOIN first_crm c ON c.pan = r.pan),
cand AS (
  SELECT r.source, r.raw_row_index, r.investor_name AS rep_name, c.crm_order, c.investor_name AS crm_name, 0 AS kind
  FROM exact r JOIN crm c ON c.mobile = r.mobile WHERE r.hit IS NULL
  UNION ALL
  SELECT r.source, r.raw_row_index, r.investor_name, c.crm_order, c.investor_name, 1
  FROM exact r JOIN crm c ON c.email = r.email WHERE r.hit IS NULL),
scored AS (SELECT *, CASE WHEN rep_name = crm_name THEN 100.0::DOUBLE ELSE
    200.0::DOUBLE * least(length(rep_name), length(crm_name)) / (2 * least(length(rep_name), length(crm_name)) + 2) END AS score,
  CASE WHEN source = 'CAMS' THEN 88.0 ELSE 90.0 END AS threshold FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_row_index ORDER BY score DESC, kind, crm_order) AS n
  FROM scored WHERE score >= threshold) WHERE n = 1),
aligned AS (
  SELECT r.*, coalesce(r.hit, b.crm_order) AS master, CASE WHEN r.hit IS NOT NULL THEN 'EXACT_PAN' WHEN b.kind = 0
    THEN 'FUZZY_NAME_AND_MOBILE' WHEN b.kind = 1 THEN 'FUZZY_NAME_AND_EMAIL' ELSE 'UNMATCHED' END AS route,
    CASE WHEN r.hit IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(b.score / 100, 0.0::DOUBLE) END AS confidence
  FROM exact r LEFT JOIN best b USING (raw_row_index)),
pairs AS (SELECT a.*, c.crm_client_id, c.pan AS c_pan, c.investor_name AS c_name, c.mobile AS c_mobile, c.email AS c_email,
  c.kyc_status AS c_kyc, c.fatca_status AS c_fatca, c.investor_status AS c_status, c.total_amount AS c_amount
  FROM aligned a JOIN crm c ON c.crm_order = a.master),
diff AS (
  SELECT *, 'PAN_MISMATCH' AS type, 'pan' AS field, c_pan AS cv, pan AS rv, 'HIGH' AS severity, 'Pan' AS title FROM pairs WHERE c_pan <> pan
  UNION ALL SELECT *, 'NAME_MISMATCH', 'investor_name', c_name, investor_name, 'HIGH', 'Investor Name' FROM pairs WHERE c_name <> investor_name
  UNION ALL SELECT *, 'MOBILE_MISMATCH', 'mobile', c_mobile, mobile, 'MEDIUM', 'Mobile' FROM pairs WHERE c_mobile IS DISTINCT FROM mobile
  UNION ALL SELECT *, 'EMAIL_MISMATCH', 'email', c_email, email, 'MEDIUM', 'Email' FROM pairs WHERE c_email IS DISTINCT FROM email AND source <> 'KFINTECH'
  UNION ALL SELECT *, 'KYC_MISMATCH', 'kyc_status', c_kyc, kyc_status, 'MEDIUM', 'Kyc Status' FROM pairs WHERE c_kyc <> kyc_status
  UNION ALL SELECT *, 'FATCA_MISMATCH', 'fatca_status', c_fatca, fatca_status, 'HIGH', 'Fatca Status' FROM pairs WHERE c_fatca <> fatca_status
  UNION ALL SELECT *, 'STATUS_MISMATCH', 'investor_status', c_status, investor_status, 'HIGH', 'Investor Status' FROM pairs WHERE c_status <> investor_status
  UNION ALL SELECT *, 'AMOUNT_MISMATCH', 'total_amount', CAST(c_amount AS VARCHAR), CAST(total_amount AS VARCHAR), 'CRITICAL', 'Total Amount'
    FROM pairs WHERE abs(c_amount - total_amount) > 0.05),
lost AS (SELECT * FROM crm WHERE crm_client_id NOT IN (SELECT crm_client_id FROM pairs)),
disc AS (
  SELECT type AS discrepancy_type, pan, field AS field_name, cv AS crm_value, rv AS report_value, severity,
    CASE WHEN type = 'AMOUNT_MISMATCH' THEN format('Amount mismatch detected. CRM value {{:.2f}} differs from Report value {{:.2f}}.', CAST(cv AS DOUBLE), CAST(rv AS DOUBLE))
    ELSE concat(title, ' mismatch detected. CRM value ''', coalesce(cv, 'None'), ''' differs from Report value ''', coalesce(rv, 'None'), '''.') END AS explanation,
    source, file_name, raw_row_index, folio_number, crm_client_id, route, confidence,
    list_position(['pan','investor_name','mobile','email','kyc_status','fatca_status','investor_status','date','total_amount'], field) AS field_no FROM diff
  UNION ALL SELECT 'FUZZY_MATCH_WARNING', pan, NULL, NULL, NULL, 'MEDIUM',
    format('Fuzzy match warning: Record aligned via name similarity of {{:.1f}}% using route ''{{}}''.', confidence * 100, route),
    source, file_name, raw_row_index, folio_number, crm_client_id, route, confidence, 99 FROM pairs WHERE route LIKE 'FUZZY%'
  UNION ALL SELECT 'MISSING_IN_CRM', pan, NULL, NULL, NULL, 'CRITICAL',
    concat('Record with PAN ''', pan, ''' and Folio ''', folio_number, ''' is missing in CRM database.'),
    source, file_name, raw_row_index, folio_number, NULL, route, confidence, 0 FROM aligned WHERE route = 'UNMATCHED'
  UNION ALL SELECT CASE WHEN mobile IS NULL THEN 'INCOMPLETE_CRM_RECORD' ELSE 'MISSING_IN_REPORT' END, pan, NULL, NULL, NULL,
    CASE WHEN mobile IS NULL THEN 'MEDIUM' ELSE 'HIGH' END,
    CASE WHEN mobile IS NULL THEN concat('CRM Record Client ID ''', crm_client_id, ''' with PAN ''', pan,
      ''' is incomplete (missing contact info: mobile/email, and compliance status: KYC/FATCA) and is not present in processed reports.')
    ELSE concat('CRM Client ID ''', crm_client_id, ''' with PAN ''', pan, ''' is missing in the processed report files.') END,
    'CRM', NULL, crm_order, NULL, crm_client_id, 'UNMATCHED', 0.0, 0 FROM lost)
"""


def sides(spark, folder):
    reports = report_table(spark, folder).drop("email_cell_blank")
    return conform(crm_table(spark, folder), CRM), conform(reports, REPORT)


def flow(spark, folder, config=CONFIG):
    return reconcile(*sides(spark, folder), config)


def exact_pairs(spark, folder):
    """Exact matches only, lazily: what the comparison queries need."""
    crm, reports = sides(spark, folder)
    return match.align(reports, crm, EXACT_ONLY.matching, cut=lambda df: df)


# ---- matching -----------------------------------------------------------------------------------


@query("match_exact", f"""{FLOW}
SELECT r.source, r.raw_row_index, r.pan, c.crm_client_id FROM exact r LEFT JOIN crm c ON c.crm_order = r.hit""")
def match_exact(spark, folder):
    crm, reports = sides(spark, folder)
    return match.exact_match(reports, crm).select("source", "raw_row_index", "pan", F.col("crm.crm_client_id").alias("crm_client_id"))


SHARED_PAN = """
SELECT a.crm_client_id, a.crm_order, CASE WHEN a.crm_order % 31 = 1 THEN b.pan ELSE a.pan END AS pan, a.investor_name, a.mobile,
  a.email, a.kyc_status, a.fatca_status, a.investor_status, a.total_amount
FROM crm a LEFT JOIN crm b ON b.crm_order = a.crm_order - 1
"""


@query("match_first_of_shared_key", f"""{BASE}, s AS ({SHARED_PAN}),
f AS (SELECT pan, min(crm_order) AS hit FROM s GROUP BY pan),
m AS (SELECT r.raw_row_index, s.crm_client_id FROM rep r JOIN f USING (pan) JOIN s ON s.crm_order = f.hit)
SELECT s.crm_client_id, s.pan, (SELECT count(*) FROM m WHERE m.crm_client_id = s.crm_client_id) AS matched_rows FROM s""")
def match_first_of_shared_key(spark, folder):
    crm, reports = sides(spark, folder)
    shared = conform(derive(spark, folder, SHARED_PAN.replace("JOIN crm b", "JOIN {crm} b")), CRM)
    hits = match.is_matched(match.align(reports, shared, EXACT_ONLY.matching, cut=lambda df: df))
    counts = hits.groupBy(F.col("crm.crm_client_id").alias("crm_client_id")).agg(F.count(F.lit(1)).alias("n"))
    return attach(shared, counts, ["crm_client_id"]).select(
        "crm_client_id", "pan", F.coalesce("n", F.lit(0)).alias("matched_rows")
    )


@query("block_candidates", f"""{BASE}, p AS (
  SELECT r.raw_row_index, c.crm_client_id, 0 AS kind FROM rep r JOIN crm c ON c.mobile = r.mobile
  UNION ALL SELECT r.raw_row_index, c.crm_client_id, 1 FROM rep r JOIN crm c ON c.email = r.email),
k AS (SELECT raw_row_index, count(DISTINCT CASE WHEN kind = 0 THEN crm_client_id END) AS by_mobile,
  count(DISTINCT CASE WHEN kind = 1 THEN crm_client_id END) AS by_email, count(DISTINCT crm_client_id) AS candidates FROM p GROUP BY 1)
SELECT r.source, r.raw_row_index, coalesce(by_mobile, 0) AS by_mobile, coalesce(by_email, 0) AS by_email,
  coalesce(candidates, 0) AS candidates FROM rep r LEFT JOIN k USING (raw_row_index)""")
def block_candidates(spark, folder):
    crm, reports = sides(spark, folder)
    return match.candidate_counts(reports, crm).select("source", "raw_row_index", "by_mobile", "by_email", "candidates")


@query("fuzzy_score", f"""{BASE}
SELECT r.raw_row_index, round(CASE WHEN r.investor_name = c.investor_name THEN 100.0::DOUBLE
  ELSE 200.0::DOUBLE * length(c.investor_name) / (2 * length(c.investor_name) + 2) END, 6) AS score
FROM rep r JOIN crm c ON c.crm_client_id = substring(r.folio_number, 2)""")
def fuzzy_score(spark, folder):
    crm, reports = sides(spark, folder)
    names = crm.select(F.concat(F.lit("F"), "crm_client_id").alias("folio_number"), token_sort(F.col("investor_name")).alias("a"))
    pairs = attach(reports.select("raw_row_index", "folio_number", token_sort(F.col("investor_name")).alias("b")), names, ["folio_number"], "inner")
    return pairs.select("raw_row_index", F.round(sorted_name_score(F.col("a"), F.col("b")), 6).alias("score"))


@query("fuzzy_best", f"""{FLOW}
SELECT source, raw_row_index, master, route, round(confidence, 6) AS confidence FROM aligned WHERE hit IS NULL""")
def fuzzy_best(spark, folder):
    aligned = flow(spark, folder).aligned.filter("match_route != 'EXACT_PAN'")
    return aligned.select("source", "raw_row_index", F.col("crm.crm_order").alias("master"), F.col("match_route").alias("route"),
                          F.round("match_confidence", 6).alias("confidence"))


@query("fuzzy_threshold", f"""{FLOW}, b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_row_index ORDER BY score DESC, kind, crm_order) AS n
  FROM scored WHERE score >= CASE WHEN source = 'NSE' THEN 95.9 ELSE 97 END AND source <> 'KFINTECH') WHERE n = 1)
SELECT e.source, e.raw_row_index, b.crm_order AS master, CASE WHEN b.kind IS NULL THEN 'UNMATCHED' WHEN b.kind = 0
  THEN 'FUZZY_NAME_AND_MOBILE' ELSE 'FUZZY_NAME_AND_EMAIL' END AS route FROM exact e LEFT JOIN b2 b USING (raw_row_index) WHERE e.hit IS NULL""")
def fuzzy_threshold(spark, folder):
    """Per-source options: a higher threshold, another for one source, off for a third."""
    matching = Matching(
        enable_fuzzy_matching=True, fuzzy_threshold=0.97, fuzzy_secondary_keys=("mobile", "email"),
        source_overrides={"NSE": {"fuzzy_threshold": 95.9}, "KFINTECH": {"enable_fuzzy_matching": False}},
    )
    aligned = flow(spark, folder, replace(CONFIG, matching=matching)).aligned.filter("match_route != 'EXACT_PAN'")
    return aligned.select("source", "raw_row_index", F.col("crm.crm_order").alias("master"), F.col("match_route").alias("route"))


@query("matched_pairs", f"""{FLOW} SELECT raw_row_index, source, pan, crm_client_id, c_pan AS crm_pan, route FROM pairs""")
def matched_pairs(spark, folder):
    return flow(spark, folder).matched.select(
        "raw_row_index", "source", "pan", F.col("crm.crm_client_id").alias("crm_client_id"), F.col("crm.pan").alias("crm_pan"),
        F.col("match_route").alias("route"))


@query("missing_in_crm", f"""{FLOW} SELECT source, raw_row_index, pan, folio_number FROM aligned WHERE route = 'UNMATCHED'""")
def missing_in_crm(spark, folder):
    return flow(spark, folder).missing_in_crm.select("source", "raw_row_index", "pan", "folio_number")


@query("missing_in_report", f"""{FLOW} SELECT crm_client_id, pan FROM lost""")
def missing_in_report(spark, folder):
    return flow(spark, folder).missing_in_report.select("crm_client_id", "pan")


@query("incomplete_crm", f"""{BASE} SELECT crm_client_id, mobile IS NULL AND email IS NULL AND kyc_status = 'UNKNOWN'
  AND fatca_status = 'UNKNOWN' AS incomplete FROM crm""")
def incomplete_crm(spark, folder):
    return sides(spark, folder)[0].select("crm_client_id", match.is_incomplete().alias("incomplete"))


# ---- comparison ---------------------------------------------------------------------------------


@query("compare_fields", f"""{FLOW}
SELECT source, raw_row_index, type AS discrepancy_type, field AS field_name, cv AS crm_value, rv AS report_value FROM diff
WHERE route = 'EXACT_PAN'""")
def compare_fields(spark, folder):
    found = compare.report_discrepancies(match.is_matched(exact_pairs(spark, folder)), CONFIG, which=("field",))
    return found.select("source", "raw_row_index", "discrepancy_type", "field_name", "crm_value", "report_value")


@query("tolerance_amount", f"""{FLOW}
SELECT raw_row_index, abs(c_amount - total_amount) > 0.05 AS differs FROM pairs WHERE route = 'EXACT_PAN'""")
def tolerance_amount(spark, folder):
    pairs = match.is_matched(exact_pairs(spark, folder))
    return pairs.select("raw_row_index", compare.amount_differs(F.col("crm.total_amount"), F.col("total_amount"), 0.05).alias("differs"))


DATES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS a,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL '1' DAY * (o_orderkey % 8) AS DATE) END AS b FROM orders
"""


@query("tolerance_date", f"""WITH d AS ({DATES})
SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN FALSE WHEN a IS NULL OR b IS NULL THEN TRUE
  ELSE abs(datediff('day', a, b)) > 3 END AS differs FROM d""")
def tolerance_date(spark, folder):
    day = F.to_date("o_orderdate")
    dates = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 29 != 0, day).alias("a"),
        F.when(F.col("o_orderkey") % 31 != 0, F.date_add(day, (F.col("o_orderkey") % 8).cast("int"))).alias("b"))
    return dates.select("o_orderkey", compare.date_differs(F.col("a"), F.col("b"), 3).alias("differs"))


@query("presence_discrepancies", f"""{FLOW}, p AS (
  SELECT *, CASE WHEN source = 'NSE' THEN 'FIELD_MISSING' END AS m, CASE WHEN email_cell_blank AND source <> 'KFINTECH' THEN 'FIELD_EMPTY' END AS e
  FROM pairs WHERE route = 'EXACT_PAN')
SELECT source, raw_row_index, m AS discrepancy_type, 'mobile' AS field_name,
  concat('Mobile column missing from NSE source file. CRM value ''', coalesce(c_mobile, 'None'), ''' could not be compared.') AS explanation FROM p WHERE m IS NOT NULL
UNION ALL SELECT source, raw_row_index, e, 'email', concat('Email column exists in ', source, ' but value is blank/empty. CRM value ''',
  coalesce(c_email, 'None'), ''' could not be compared.') FROM p WHERE e IS NOT NULL""")
def presence_discrepancies(spark, folder):
    blank = report_table(spark, folder).withColumns({
        "missing_fields": F.when(F.col("source") == "NSE", F.array(F.lit("mobile"))).otherwise(F.array().cast("array<string>")),
        "empty_fields": F.when(F.col("email_cell_blank"), F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")),
    })
    crm = sides(spark, folder)[0]
    pairs = match.is_matched(match.align(conform(blank, REPORT), crm, EXACT_ONLY.matching, cut=lambda df: df))
    found = compare.report_discrepancies(pairs, CONFIG, which=("field",)).filter("discrepancy_type LIKE 'FIELD%'")
    return found.select("source", "raw_row_index", "discrepancy_type", "field_name", "explanation")


@query("skipped_notes", f"""{BASE}
SELECT source, raw_row_index, CASE WHEN source = 'KFINTECH' THEN 'EMAIL_COMPARISON_SKIPPED,DATE_COMPARISON_SKIPPED'
  ELSE 'DATE_COMPARISON_SKIPPED' END AS notes FROM rep""")
def skipped_notes(spark, folder):
    return sides(spark, folder)[1].select(
        "source", "raw_row_index", F.array_join(compare.skipped_notes(CONFIG), ",").alias("notes"))


@query("severity", f"""{FLOW} SELECT discrepancy_type, severity, count(*) AS rows FROM disc GROUP BY 1, 2""")
def severity(spark, folder):
    return flow(spark, folder).discrepancies.groupBy("discrepancy_type", "severity").agg(F.count(F.lit(1)).alias("rows"))


@query("explanations", f"""{FLOW} SELECT discrepancy_type, pan, explanation FROM disc""")
def explanations(spark, folder):
    return flow(spark, folder).discrepancies.select("discrepancy_type", "pan", "explanation")


@query("discrepancies", f"""{FLOW}
SELECT discrepancy_type, pan, field_name, crm_value, report_value, severity, explanation, source, file_name, raw_row_index,
  folio_number, crm_client_id, route, round(confidence, 6) AS confidence,
  CASE WHEN source = 'CRM' THEN 'CRM Master List' ELSE concat('SourceProfile: ', source) END AS rule,
  CASE WHEN field_name IS NULL THEN '' WHEN source = 'KFINTECH' THEN 'EMAIL_COMPARISON_SKIPPED,DATE_COMPARISON_SKIPPED'
       ELSE 'DATE_COMPARISON_SKIPPED' END AS skipped FROM disc""")
def discrepancies(spark, folder):
    trace = "audit_trace."
    return flow(spark, folder).discrepancies.select(
        "discrepancy_type", "pan", "field_name", "crm_value", "report_value", "severity", "explanation", "source", "file_name",
        "raw_row_index", "folio_number", "crm_client_id", F.col(trace + "matching_route").alias("route"),
        F.round(trace + "match_confidence", 6).alias("confidence"), F.col(trace + "rule_evaluated").alias("rule"),
        F.array_join(trace + "skipped_comparisons", ",").alias("skipped"))


@query("fuzzy_warnings", f"""{FLOW} SELECT pan, severity, explanation FROM disc WHERE discrepancy_type = 'FUZZY_MATCH_WARNING'""")
def fuzzy_warnings(spark, folder):
    aligned = flow(spark, folder).aligned
    return compare.report_discrepancies(aligned, CONFIG, which=("fuzzy",)).select("pan", "severity", "explanation")


@query("matched_audits", f"""{FLOW}
SELECT pan, route, round(confidence, 6) AS confidence, source, CASE WHEN source = 'KFINTECH'
  THEN 'EMAIL_COMPARISON_SKIPPED,DATE_COMPARISON_SKIPPED' ELSE 'DATE_COMPARISON_SKIPPED' END AS skipped FROM pairs""")
def matched_audits(spark, folder):
    return flow(spark, folder).matched_audits.select(
        "pan", "route", F.round("confidence", 6).alias("confidence"), "source", F.array_join("skipped_comparisons", ",").alias("skipped"))


# ---- metrics ------------------------------------------------------------------------------------


@query("run_statistics", f"""{FLOW}
SELECT (SELECT count(*) FROM crm) + (SELECT count(*) FROM rep) AS total_records, (SELECT count(*) FROM pairs) AS matched_count,
  (SELECT count(*) FROM aligned WHERE route = 'UNMATCHED') + (SELECT count(*) FROM lost) AS unmatched_count,
  (SELECT count(*) FROM disc) AS discrepancy_count""")
def run_statistics(spark, folder):
    crm, reports = sides(spark, folder)
    r = reconcile(crm, reports, CONFIG)
    return metrics.run_statistics(crm, reports, r.matched, r.missing_in_crm, r.missing_in_report, r.discrepancies)


@query("summary_metrics", f"""{FLOW}
SELECT (SELECT count(*) FROM crm) AS total_crm_records, (SELECT count(*) FROM rep) AS total_report_records,
  (SELECT count(*) FROM pairs) AS matched_records, count(*) FILTER (WHERE discrepancy_type = 'MISSING_IN_CRM') AS missing_in_crm,
  count(*) FILTER (WHERE discrepancy_type = 'MISSING_IN_REPORT') AS missing_in_report,
  count(*) FILTER (WHERE discrepancy_type NOT IN ('MISSING_IN_CRM', 'MISSING_IN_REPORT')) AS field_discrepancies,
  0::BIGINT AS validation_failures, 0::BIGINT AS failed_files_count FROM disc""")
def summary_metrics(spark, folder):
    crm, reports = sides(spark, folder)
    r = reconcile(crm, reports, CONFIG)
    return metrics.summary_metrics(crm, reports, r.matched, r.discrepancies)


@query("breakdown_by_type", f"""{FLOW} SELECT discrepancy_type, count(*) AS count FROM disc GROUP BY 1 ORDER BY 1""")
def breakdown_by_type(spark, folder):
    return metrics.breakdown_by_type(flow(spark, folder).discrepancies)


_BREAKDOWN = f"""{FLOW}, b AS (
SELECT source, count(*) AS processed, count(*) FILTER (WHERE route <> 'UNMATCHED') AS matched,
  (SELECT count(DISTINCT pan) FROM disc d WHERE d.source = a.source) AS discrepancies FROM aligned a GROUP BY source)
"""


@query("source_breakdown", _BREAKDOWN + "SELECT * FROM b")
def source_breakdown(spark, folder):
    r = flow(spark, folder)
    return metrics.source_breakdown(r.aligned, r.discrepancies)


@query("source_match_rate", _BREAKDOWN + """
SELECT source, round(matched::DOUBLE / processed * 100, 6) AS match_rate, CASE WHEN matched::DOUBLE / processed * 100 >= 95 THEN 'good'
  WHEN matched::DOUBLE / processed * 100 >= 80 THEN 'fair' ELSE 'poor' END AS band FROM b""")
def source_match_rate(spark, folder):
    r = flow(spark, folder)
    rated = metrics.source_match_rate(metrics.source_breakdown(r.aligned, r.discrepancies))
    return rated.select("source", F.round("match_rate", 6).alias("match_rate"), "band")


@query("match_rate", f"""{FLOW}, k AS (SELECT (SELECT count(*) FROM crm) AS n, count(*) AS lost FROM disc WHERE discrepancy_type = 'MISSING_IN_REPORT')
SELECT n AS total_crm_records, n - lost AS matched_records, round_even((n - lost)::DOUBLE / n * 100, 1) AS match_rate_percent FROM k""")
def match_rate(spark, folder):
    crm, reports = sides(spark, folder)
    return metrics.match_rate(crm, reconcile(crm, reports, CONFIG).discrepancies)


@query("clean_sources", f"""{FLOW}
SELECT c_pan AS pan, concat(CASE WHEN source = 'NSE' THEN 'NSE' ELSE 'CAMS/KFintech' END, ' (code ', folio_number, ')') AS source_label
FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM disc d WHERE d.file_name = p.file_name AND d.raw_row_index = p.raw_row_index)""")
def clean_sources(spark, folder):
    r = flow(spark, folder)
    return metrics.clean_sources(r.matched, r.discrepancies).select("pan", "source_label")


_WHERE = "CASE WHEN file_name LIKE 'nse%' THEN 'NSE' WHEN file_name IS NULL THEN 'External source' ELSE 'CAMS/KFintech' END"
_LABEL = """CASE field_name WHEN 'pan' THEN 'PAN' WHEN 'investor_name' THEN 'Name' WHEN 'mobile' THEN 'Mobile' WHEN 'email' THEN 'Email'
  WHEN 'kyc_status' THEN 'KYC status' WHEN 'fatca_status' THEN 'Fatca Status' WHEN 'investor_status' THEN 'Investor Status'
  WHEN 'total_amount' THEN 'Total Amount' ELSE '' END"""


@query("key_issues", f"""{FLOW}, t AS (SELECT CASE WHEN discrepancy_type = 'MISSING_IN_CRM' THEN concat('Record present in ', {_WHERE}, ' but missing in CRM')
  WHEN discrepancy_type = 'MISSING_IN_REPORT' THEN concat('Record present in CRM but missing in ', {_WHERE})
  ELSE concat({_LABEL}, ' for ', {_WHERE}, ' does not match CRM') END AS issue FROM disc)
SELECT issue, count(*) AS occurrences FROM t GROUP BY 1""")
def key_issues(spark, folder):
    return metrics.key_issues(flow(spark, folder).discrepancies).select("issue", "occurrences")


# ---- views --------------------------------------------------------------------------------------

_MATRIX_FIELDS = [
    ("Name", "c_name", "investor_name", "c_name <> investor_name"), ("PAN", "c_pan", "pan", "c_pan <> pan"),
    ("Email", "c_email", "email", None), ("Mobile", "c_mobile", "mobile", None), ("KYC status", "c_kyc", "kyc_status", None),
]
_EMPTY_FIELDS = ["Date of Birth", "Bank name", "Bank account", "IFSC", "Registered address", "Mode of holding", "Nominee 1",
                 "Nominee relation / %", "Distributor (ARN)"]
CELLS_SQL = " UNION ALL ".join(
    [f"SELECT c_pan AS pan, column_label, '{n}' AS field, coalesce({c}, '—') AS crm_value, coalesce({v}, '—') AS value, "
     f"CASE WHEN {v} IS NULL THEN 'none' WHEN {d or 'FALSE'} THEN 'mismatch' ELSE 'match' END AS status FROM lab"
     for n, c, v, d in _MATRIX_FIELDS]
    + [f"SELECT c_pan, column_label, '{n}', '—', '—', 'none' FROM lab" for n in _EMPTY_FIELDS]
)


@query("field_matrix", f"""{FLOW}, lab AS (SELECT *, concat(CASE WHEN source = 'NSE' THEN 'NSE' ELSE 'CAMS/KFintech' END, ' (code ', folio_number, ')') AS column_label FROM pairs)
{CELLS_SQL}""")
def field_matrix(spark, folder):
    long = views.field_matrix_long(flow(spark, folder).aligned, CONFIG)
    return long.select("pan", "column_label", "field", "crm_value", "value", "status")


MATRIX_PAGE = 500  # columns of a client's matrix that are read at once


def merged_matrix(long, pan, groups):
    """A client's whole matrix, its columns merged into one per group, the greatest text first. A client whose
    PAN several report rows hold has as many columns. `groups`: name -> start of the path of its files."""
    pages, number, full = [], 0, True
    while full:
        page = views.field_matrix(long, pan, page=number, per_page=MATRIX_PAGE)
        files = {f.name: f.metadata["file"] for f in page.schema.fields if "file" in f.metadata}
        cells = {g: [F.col(f"`{c}`") for c, file in files.items() if file.startswith(start)] for g, start in groups.items()}
        pages.append(page.select("field", F.col("CRM (reference)").alias("crm_value"), *[
            (F.array_max(F.array(*of)) if of else F.lit(None).cast("string")).alias(g) for g, of in cells.items()]))
        number, full = number + 1, len(files) == MATRIX_PAGE
    return reduce(DataFrame.unionByName, pages).groupBy("field").agg(*[F.max(c).alias(c) for c in ("crm_value", *groups)])


@query("client_matrix", f"""{FLOW}, one AS (SELECT min(c_pan) AS p FROM pairs), lab AS (SELECT pairs.*, 'x' AS column_label FROM pairs, one WHERE c_pan = p),
cells AS ({CELLS_SQL}) SELECT field, max(crm_value) AS crm_value, max(value) AS value FROM cells GROUP BY field""")
def client_matrix(spark, folder):
    """Matrix of the first client in PAN order, as a pivot."""
    aligned = flow(spark, folder).aligned
    pan = match.is_matched(aligned).agg(F.min("crm.pan")).first()[0]
    return merged_matrix(views.field_matrix_long(aligned, CONFIG), pan, {"value": ""})


_FOUND = """CASE discrepancy_type WHEN 'MISSING_IN_CRM' THEN 'Record exists in report but not in CRM'
  WHEN 'MISSING_IN_REPORT' THEN 'Record exists in CRM but missing from report' ELSE coalesce(report_value, '—') END"""
_SHOULD = """CASE discrepancy_type WHEN 'MISSING_IN_CRM' THEN 'Register investor in CRM'
  WHEN 'MISSING_IN_REPORT' THEN 'Verify if folio exists or assets transferred' ELSE coalesce(crm_value, '—') END"""


@query("action_list", f"""{FLOW}, t AS (SELECT *, CASE WHEN file_name LIKE 'nse%' THEN 'NSE' WHEN file_name IS NULL THEN 'crm_data.xlsx' ELSE 'CAMS/KFintech' END AS src,
  concat('Investor — ', {_LABEL}) AS field_record, {_FOUND} AS found_value, {_SHOULD} AS should_be,
  CASE discrepancy_type WHEN 'MISSING_IN_CRM' THEN 'Create new client profile in CRM for this investor using details from RTA report.'
    WHEN 'NAME_MISMATCH' THEN 'Verify legal name in PAN card and align CRM and RTA systems.'
    ELSE 'Verify discrepancy details between CRM and report file and correct the mismatch.' END AS action FROM disc),
u AS (SELECT *, row_number() OVER (PARTITION BY src, field_record, found_value, should_be
  ORDER BY source = 'CRM', file_name, raw_row_index, field_no) AS n FROM t)
SELECT severity, src AS source, field_record, found_value, should_be, action AS recommended_action FROM u WHERE n = 1
UNION ALL
SELECT DISTINCT 'HIGH', CASE WHEN source = 'NSE' THEN 'NSE' ELSE 'CAMS/KFintech' END, concat('Duplicate record, code ''', folio_number, ' '''),
  concat('Duplicate row ', raw_row_index + 1000000, ' found in ', source), 'No duplicates — deactivate/merge',
  'Investigate duplicate PAN. Address belongs to a different family member. Deactivate/merge into clean code.'
FROM rep WHERE (raw_row_index - 2) % 17 = 0""")
def action_list(spark, folder):
    from tallyframe.operators.dedup import duplicates

    copies = duplicates(conform(derive(spark, folder, COPIES, rep=report_table(spark, folder)), REPORT))
    return views.action_list(flow(spark, folder).discrepancies, copies).drop("rank")


@query("values_match", f"""{BASE}, d AS (SELECT crm_order, mobile, CASE crm_order % 3 WHEN 0 THEN concat('+91 ', mobile) WHEN 1 THEN mobile ELSE '9000000001' END AS m2,
  kyc_status, CASE crm_order % 2 WHEN 0 THEN 'Compliant' ELSE 'x' END AS k2 FROM crm)
SELECT crm_order, mobile IS NOT NULL AND crm_order % 3 <> 2 OR mobile IS NULL AND crm_order % 3 <> 2 AS mobile_same,
  TRUE AS amount_same, crm_order % 2 = 0 AND kyc_status = 'VERIFIED' AS kyc_same, TRUE AS account_same, TRUE AS date_same FROM d""")
def values_match(spark, folder):
    n = F.col("crm_order")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (n % 1000).cast("int"))
    df = sides(spark, folder)[0].select(
        "crm_order", "mobile", "kyc_status", F.col("crm_client_id").alias("account"),
        F.when(n % 3 == 0, F.concat(F.lit("+91 "), "mobile")).when(n % 3 == 1, F.col("mobile")).otherwise("9000000001").alias("mobile_2"),
        F.col("total_amount").cast("string").alias("amount"), F.format_number("total_amount", 2).alias("amount_2"),
        F.when(n % 2 == 0, "Compliant").otherwise("x").alias("kyc_2"), F.concat(F.lit("000"), "crm_client_id").alias("account_2"),
        F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(day, "dd MMM yyyy").alias("day_2"))
    tests = [("mobile", "mobile_2", "mobile", "mobile_same"), ("amount", "amount_2", "total_amount", "amount_same"),
             ("kyc_status", "kyc_2", "kyc_status", "kyc_same"), ("account", "account_2", "bank_account", "account_same"),
             ("day", "day_2", "date_of_birth", "date_same")]
    for a, b, field, name in tests:
        df = views.values_match(df, a, b, field, name)
    return df.select("crm_order", *[name for *_, name in tests])


@query("display_values", f"""{BASE}
SELECT raw_row_index, CASE WHEN raw_row_index % 3 = 0 THEN '(not in row)' WHEN raw_row_index % 3 = 1 THEN '—' ELSE coalesce(mobile, '—') END AS mobile,
  format('{{:,.2f}}', total_amount::DOUBLE) AS amount, CASE WHEN raw_row_index % 2 = 0 THEN 'KRA ok' ELSE kyc_status END AS kyc FROM rep""")
def display_values(spark, folder):
    n, none = F.col("raw_row_index"), F.array().cast("array<string>")
    one = F.array(F.lit("mobile"))
    missing, empty = F.when(n % 3 == 0, one).otherwise(none), F.when(n % 3 == 1, one).otherwise(none)
    return sides(spark, folder)[1].select(
        "raw_row_index", views.display_value(F.col("mobile"), "mobile", missing, empty).alias("mobile"),
        views.display_value(F.col("total_amount"), "total_amount", none, none).alias("amount"),
        views.display_value(F.col("kyc_status"), "kyc_status", none, none, F.when(n % 2 == 0, " KRA ok ").otherwise("nan")).alias("kyc"))


@query("column_labels", f"""{BASE}, f AS (SELECT DISTINCT CASE raw_row_index % 2 WHEN 0 THEN 'NSE' ELSE source END AS source,
  CASE WHEN raw_row_index % 2 = 0 THEN concat('nse_master_part', raw_row_index % 4, '.csv') ELSE file_name END AS file_name FROM rep),
n AS (SELECT source, count(DISTINCT file_name) AS n FROM f GROUP BY source)
SELECT source, file_name, CASE WHEN source <> 'NSE' THEN 'CAMS/KFintech'
  WHEN file_name = 'nse_report.csv' THEN 'NSE (Report)' ELSE concat('NSE (Part', substring(file_name, 16, 1), ')') END AS column_label FROM f JOIN n USING (source)""")
def column_labels(spark, folder):
    n = F.col("raw_row_index")
    files = sides(spark, folder)[1].select(
        F.when(n % 2 == 0, "NSE").otherwise(F.col("source")).alias("source"),
        F.when(n % 2 == 0, F.concat(F.lit("nse_master_part"), (n % 4).cast("string"), F.lit(".csv")))
        .otherwise(F.col("file_name")).alias("file_name")).distinct()
    return views.label_files(files)


@query("redact", f"""{FLOW}
SELECT discrepancy_type, raw_row_index, concat(substring(pan, 1, 5), '****', substring(pan, 10, 1)) AS pan,
  CASE WHEN field_name = 'pan' THEN concat(substring(crm_value, 1, 5), '****', substring(crm_value, 10, 1)) ELSE crm_value END AS crm_value,
  CASE WHEN field_name = 'pan' THEN concat(substring(report_value, 1, 5), '****', substring(report_value, 10, 1)) ELSE report_value END AS report_value,
  regexp_replace(regexp_replace(regexp_replace(explanation, '\\b([A-Z]{{5}})[0-9]{{4}}([A-Z])\\b', '\\1****\\2', 'g'),
    '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@', '\\1****@', 'g'), '\\b[0-9]{{6}}([0-9]{{4}})\\b', '******\\1', 'g') AS explanation
FROM disc""")
def redact(spark, folder):
    return views.redact(flow(spark, folder).discrepancies).select("discrepancy_type", "raw_row_index", "pan", "crm_value", "report_value", "explanation")


@query("search", f"""{FLOW} SELECT discrepancy_type, pan, explanation FROM disc
WHERE (contains(lower(pan), 'furniture') OR contains(lower(explanation), 'furniture')) AND severity = 'HIGH' AND source = 'CAMS'""")
def search(spark, folder):
    found = views.search(flow(spark, folder).discrepancies, "Furniture", severity="high", source="cams")
    return found.select("discrepancy_type", "pan", "explanation")


@query("top_severity_page", f"""{FLOW} SELECT discrepancy_type, pan, severity FROM disc
ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, source = 'CRM', file_name, raw_row_index, field_no LIMIT 10 OFFSET 10""")
def top_severity_page(spark, folder):
    return views.page(flow(spark, folder).discrepancies, number=2).select("discrepancy_type", "pan", "severity")


@query("client_extract", f"""{FLOW}, w AS (SELECT pan FROM (SELECT DISTINCT pan FROM disc) ORDER BY pan LIMIT 3)
SELECT d.discrepancy_type, d.pan, d.explanation FROM disc d JOIN w USING (pan)""")
def client_extract(spark, folder):
    found = flow(spark, folder).discrepancies
    pans = [r.pan for r in found.select("pan").distinct().orderBy("pan").limit(3).collect()]
    return views.client_extract(found, pans).select("discrepancy_type", "pan", "explanation")


# ---- exports ------------------------------------------------------------------------------------


@query("discrepancy_export", f"""{FLOW}
SELECT discrepancy_type, pan, coalesce(field_name, '') AS field_name, coalesce(crm_value, '') AS crm_value, coalesce(report_value, '') AS report_value,
  severity, explanation, coalesce(file_name, 'N/A') AS file_name, CASE WHEN source = 'CRM' THEN 'N/A' ELSE CAST(raw_row_index AS VARCHAR) END AS raw_row_index,
  coalesce(folio_number, 'N/A') AS folio_number FROM disc""")
def discrepancy_export(spark, folder):
    return sinks.discrepancy_export(flow(spark, folder).discrepancies)


@query("matched_export", f"""{FLOW}
SELECT c_pan AS pan, c_name AS investor_name, coalesce(c_mobile, '') AS mobile, coalesce(c_email, '') AS email, c_kyc AS kyc_status, c_fatca AS fatca_status,
  c_status AS investor_status, '' AS last_transaction_date, CAST(c_amount AS VARCHAR) AS total_amount, crm_client_id, source AS report_source,
  folio_number AS report_folio, raw_row_index AS report_raw_row_index FROM pairs""")
def matched_export(spark, folder):
    return sinks.matched_export(flow(spark, folder).matched)


@query("unmatched_export", f"""{FLOW}
SELECT 'REPORT' AS record_type, pan, investor_name, coalesce(mobile, '') AS mobile, coalesce(email, '') AS email, kyc_status, fatca_status, investor_status,
  '' AS last_transaction_date, CAST(total_amount AS VARCHAR) AS total_amount, '' AS crm_client_id, source AS report_source, folio_number AS report_folio,
  CAST(raw_row_index AS VARCHAR) AS report_raw_row_index FROM aligned WHERE route = 'UNMATCHED'
UNION ALL SELECT 'CRM', pan, investor_name, coalesce(mobile, ''), coalesce(email, ''), kyc_status, fatca_status, investor_status, '',
  CAST(total_amount AS VARCHAR), crm_client_id, '', '', '' FROM lost""")
def unmatched_export(spark, folder):
    r = flow(spark, folder)
    return sinks.unmatched_export(r.missing_in_crm, r.missing_in_report)


@query("run_history", f"""{FLOW}, k AS (SELECT (SELECT count(*) FROM crm) AS n, count(*) FILTER (WHERE discrepancy_type = 'MISSING_IN_REPORT') AS lost, count(*) AS d FROM disc)
SELECT run_id, round_even((n - lost)::DOUBLE / n * 100, 1) AS match_rate_percent, d AS discrepancy_count, 'success' AS status
FROM k, (SELECT unnest(['RUN-001', 'RUN-002']) AS run_id)""")
def run_history(spark, folder):
    crm, reports = sides(spark, folder)
    found = reconcile(crm, reports, CONFIG).discrepancies
    rate = metrics.match_rate(crm, found).first().match_rate_percent
    summary = {"match_rate_percent": rate, "discrepancy_count": found.count()}
    history = sinks.RunHistory(spark, f"{scratch_folder(spark)}/history-{uuid.uuid4().hex}")
    for _ in range(2):
        history.save(summary, "", "crm", 1)
    return history.list().select("run_id", "match_rate_percent", "discrepancy_count", "status")


@query("statement_blocks", f"""{BASE}
SELECT concat('nation', c_nationkey, '.pdf') AS file_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS block_no, pan,
  CASE WHEN c_custkey % 3 <> 0 THEN mobile END AS mobile, abs(total_amount) AS total_amount,
  CASE WHEN c_custkey % 4 <> 0 THEN concat('F', crm_client_id) END AS folio_number, email
FROM customer JOIN crm ON crm_order = c_custkey""")
def statement_blocks(spark, folder):
    crm, customers = crm_table(spark, folder), table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    person = customers.join(crm, F.col("c_custkey") == F.col("crm_order"))
    n = F.col("c_custkey")
    texts = [
        F.lit("Investor Name: HOLDER OF"), F.concat(F.lit("PAN: "), "pan"),
        F.when(n % 3 != 0, F.concat(F.lit("Mobile: +91 "), "mobile")),
        F.concat(F.lit("Amount: "), F.abs("total_amount").cast("string")),
        F.when(n % 4 != 0, F.concat(F.lit("Folio Number: F"), "crm_client_id")), F.concat(F.lit("Email: "), "email"),
    ]
    lines = person.select(
        F.lit("statements").alias("file_id"), F.concat(F.lit("nation"), "c_nationkey", F.lit(".pdf")).alias("file_name"), n,
        F.posexplode(F.array(*texts)).alias("i", "line"),
    ).select("file_id", "file_name", (n * 10 + F.col("i")).alias("line_no"), "line").filter("line IS NOT NULL")
    rows = statements.parse_statements(lines)
    return rows.select("file_name", F.col("raw_row_index").alias("block_no"), "pan", "mobile",
                       F.col("total_amount").cast("decimal(18,2)").alias("total_amount"), "folio_number", "email")
