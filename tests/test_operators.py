"""Comparison, validation and de-duplication on literal cases."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.config import Profiles, ReconConfig, SourceProfile, Validation
from tallyframe.operators import views
from tallyframe.operators.dedup import dedup_first, duplicates
from tallyframe.operators.normalize import normalize, split_normalized
from tallyframe.operators.validate import explode_failures, split_valid, with_failures
from tallyframe.plans.reconcile import reconcile
from tallyframe.schema import CRM, REPORT, conform

ONE = {"crm_client_id": "C1", "crm_order": 0, "pan": "ABCDE1234F", "investor_name": "ASHA RAO", "mobile": "9876543210",
       "email": "a@x.org", "kyc_status": "VERIFIED", "fatca_status": "COMPLIANT", "investor_status": "ACTIVE",
       "total_amount": "100.00", "last_transaction_date": dt.date(2026, 1, 10)}
SHAPE = ("pan string, investor_name string, mobile string, email string, kyc_status string, fatca_status string,"
         " investor_status string, total_amount string, last_transaction_date date")


def crm_rows(spark, *rows):
    data = [{**ONE, "crm_order": i, **r} for i, r in enumerate(rows)]
    return conform(spark.createDataFrame(data, "crm_client_id string, crm_order bigint, " + SHAPE), CRM)


def report_rows(spark, *rows):
    base = {k: v for k, v in ONE.items() if not k.startswith("crm")}
    data = [{**base, "source": "CAMS", "folio_number": "F1", "raw_row_index": i + 2, "missing_fields": [], "empty_fields": [],
             "file_name": "cams.csv", "file_id": "in", **r} for i, r in enumerate(rows)]
    return conform(spark.createDataFrame(
        data, "source string, folio_number string, raw_row_index bigint, missing_fields array<string>,"
              " empty_fields array<string>, file_name string, file_id string, " + SHAPE), REPORT)


def found(spark, crm, rep, config=ReconConfig()):
    rows = reconcile(crm, rep, config, cut=lambda df: df).discrepancies.collect()
    return {(r.discrepancy_type, r.field_name, r.severity) for r in rows}


def test_equal_rows_have_no_discrepancy(spark):
    assert found(spark, crm_rows(spark, {}), report_rows(spark, {})) == set()


def test_every_default_field(spark):
    rep = report_rows(spark, {"investor_name": "X", "mobile": None, "email": "b@x.org", "kyc_status": "PENDING",
                              "fatca_status": "UNKNOWN", "investor_status": "INACTIVE", "total_amount": "100.02"})
    assert {t for t, _, _ in found(spark, crm_rows(spark, {}), rep)} == {
        "NAME_MISMATCH", "MOBILE_MISMATCH", "EMAIL_MISMATCH", "KYC_MISMATCH", "FATCA_MISMATCH", "STATUS_MISMATCH", "AMOUNT_MISMATCH"}
    assert found(spark, crm_rows(spark, {}), report_rows(spark, {"total_amount": "100.01"})) == set()


@pytest.mark.parametrize("field", ["investor_status", "mobile", "email"])
def test_presence_wins_over_mismatch(spark, field):
    rep = report_rows(spark, {field: None, "missing_fields": [field]}, {field: None, "empty_fields": [field], "raw_row_index": 3})
    assert found(spark, crm_rows(spark, {}), rep) == {("FIELD_MISSING", field, "MEDIUM"), ("FIELD_EMPTY", field, "MEDIUM")}


def test_profile_skips_fields_and_dates_have_a_tolerance(spark):
    config = ReconConfig(sources={"CAMS": SourceProfile(compare=("pan", "last_transaction_date"))})
    rep = report_rows(spark, {"investor_name": "X", "last_transaction_date": dt.date(2026, 1, 13)},
                      {"raw_row_index": 3, "last_transaction_date": dt.date(2026, 1, 14)}, {"raw_row_index": 4, "last_transaction_date": None})
    rows = reconcile(crm_rows(spark, {}), rep, config, cut=lambda df: df).discrepancies.collect()
    assert {(r.raw_row_index, r.discrepancy_type) for r in rows} == {(3, "DATE_MISMATCH"), (4, "DATE_MISMATCH")}
    assert "NAME_COMPARISON_SKIPPED" in rows[0].audit_trace.skipped_comparisons and len(rows[0].audit_trace.skipped_comparisons) == 16
    assert {r.explanation for r in rows if r.raw_row_index == 4} == {
        "Transaction date mismatch detected: CRM value '2026-01-10' differs from Report value 'None' beyond configured tolerance of 3 days."}


@pytest.mark.parametrize("on,expected", [(True, ("INCOMPLETE_CRM_RECORD", None, "MEDIUM")), (False, ("MISSING_IN_REPORT", None, "HIGH"))])
def test_incomplete_master_rows(spark, on, expected):
    config = ReconConfig(validation=Validation(suppress_missing_in_report_for_incomplete_crm=on))
    crm = crm_rows(spark, {"mobile": None, "email": "", "kyc_status": "UNKNOWN", "fatca_status": None},
                   {"crm_client_id": "C2", "pan": "ABCDE1234G"})
    rep = report_rows(spark, {"pan": "ZZZZZ1234Z"})
    assert found(spark, crm, rep, config) == {expected, ("MISSING_IN_REPORT", None, "HIGH"), ("MISSING_IN_CRM", None, "CRITICAL")}


def test_duplicates_of_reports(spark):
    rep = report_rows(spark, {}, {"folio_number": "F2"}, {"folio_number": " F1 "}, {"total_amount": "101"}, {"folio_number": None},
                      {"folio_number": " "}, {"file_name": "other.csv"})
    assert {r.raw_row_index for r in dedup_first(rep).collect()} == {2, 3, 6, 8}
    got = {r.raw_row_index: (r.failure_type, list(r.conflicts)) for r in duplicates(rep).collect()}
    assert got == {4: ("EXACT_DUPLICATE", []), 5: ("CONFLICTING_DUPLICATE", ["total_amount"]), 7: ("EXACT_DUPLICATE", [])}


def test_duplicates_of_master_rows(spark):
    crm = crm_rows(spark, {}, {"crm_client_id": "C2"}, {}, {"investor_name": "B", "total_amount": "1"})
    assert {r.crm_order for r in dedup_first(crm, "crm").collect()} == {0, 1}
    got = {r.crm_order: r.message for r in duplicates(crm, "crm").collect()}
    assert got == {2: "Exact duplicate record found for PAN 'ABCDE1234F'.",
                   3: "Conflicting duplicate record found for PAN 'ABCDE1234F'. Conflict in fields: investor_name, total_amount."}


@given(st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from(["", "F1", "F2"])), min_size=1, max_size=25))
@settings(max_examples=5, deadline=None)
def test_dedup_keeps_the_first_of_each_key(spark, keys):
    rep = report_rows(spark, *[{"pan": p, "folio_number": f} for p, f in keys])
    kept = {r.raw_row_index for r in dedup_first(rep).collect()}
    dropped = {r.raw_row_index for r in duplicates(rep).collect()}
    assert kept == {keys.index(k) + 2 for k in set(keys)}
    assert kept | dropped == set(range(2, len(keys) + 2)) and not kept & dropped


def test_validation_lists_every_failure(spark):
    profile = SourceProfile(available_fields=("pan", "investor_name"), required_fields=("pan", "email"),
                            validations=(" PAN_FORMAT ", "mobile_format", "kyc_status", "fatca_status_format"))
    rep = report_rows(spark, {"pan": "BAD", "email": " ", "mobile": "1", "kyc_status": "FAILED", "fatca_status": "UNKNOWN", "total_amount": "0"},
                      {"raw_row_index": 3, "mobile": None, "investor_status": "UNKNOWN", "kyc_status": "UNKNOWN", "fatca_status": "UNKNOWN",
                       "email": None, "total_amount": "0.00", "last_transaction_date": None})
    checked = with_failures(rep, Profiles({"CAMS": profile}, profile))
    good, bad = split_valid(checked)
    rows = [(r.raw_row_index, r.failure_type, r.field_name) for r in explode_failures(bad).orderBy("raw_row_index", "failure_no").collect()]
    assert good.count() == 0
    assert rows == [
        (2, "REQUIRED_FIELD_MISSING", "email"), (2, "UNEXPECTED_FIELD", "mobile"), (2, "UNEXPECTED_FIELD", "kyc_status"),
        (2, "UNEXPECTED_FIELD", "investor_status"), (2, "UNEXPECTED_FIELD", "last_transaction_date"), (2, "INVALID_PAN_FORMAT", "pan"),
        (2, "INVALID_MOBILE_FORMAT", "mobile"), (2, "INVALID_KYC_STATUS", "kyc_status"), (2, "INVALID_FATCA_STATUS", "fatca_status"),
        (3, "REQUIRED_FIELD_MISSING", "email"), (3, "INVALID_KYC_STATUS", "kyc_status"), (3, "INVALID_FATCA_STATUS", "fatca_status")]
    narrow = with_failures(report_rows(spark, {"kyc_status": "PENDING"}), Profiles({}, SourceProfile(validations=("kyc_status",), available_fields=tuple(ONE))),
                           Validation(allowed_kyc_statuses=("VERIFIED",)))
    assert [f.failure_type for f in narrow.first().failures] == ["INVALID_KYC_STATUS"]


def test_normalize_reports_the_first_refusal_and_is_idempotent(spark):
    rep = report_rows(spark, {"pan": "abcde-1234-f", "mobile": "+91 98765 43210", "email": " A@X.org", "investor_name": "Mr. Asha  Rao",
                              "kyc_status": "kyc ok"},
                      {"raw_row_index": 3, "pan": "x", "mobile": "1"}, {"raw_row_index": 4, "mobile": "1"})
    good, bad = split_normalized(normalize(rep))
    r = good.first()
    assert (r.pan, r.mobile, r.email, r.investor_name, r.kyc_status) == ("ABCDE1234F", "9876543210", "a@x.org", "ASHA RAO", "UNKNOWN")
    assert split_normalized(normalize(good))[0].first() == r
    assert {b.raw_row_index: b.norm_error.split(":")[0] for b in bad.collect()} == {
        3: "Invalid PAN format", 4: "Mobile number must normalize to exactly 10 digits"}


@pytest.mark.parametrize("a,b,field,same", [
    ("+91 9876543210", "9876543210", "mobile", True), ("9876543211", "9876543210", "mobile", False),
    ("00123", "123", "bank_account", True), ("1,000.00", "1000", "total_amount", True), ("13-Jun-2026", "2026-06-13", "date_of_birth", True),
    ("Asha  Rao", "ASHA RAO", "investor_name", True), ("Yes", "VERIFIED", "kyc_status", True), ("No", "VERIFIED", "kyc_status", False),
    ("Individual", "Single.", "mode_of_holding", True), (None, None, "email", True), (None, "x", "email", False), ("X", "x", "email", True),
])
def test_values_match(spark, a, b, field, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert views.values_match(df, "a", "b", field, "same").first().same is same


def test_redact(spark):
    df = spark.createDataFrame([("ABCDE1234F", "asha@x.org", "9876543210", "PAN 'ABCDE1234F' mail asha@x.org tel 9876543210")],
                               "pan string, email string, mobile string, explanation string")
    assert tuple(views.redact(df).first()) == ("ABCDE****F", "a****@x.org", "******3210", "PAN 'ABCDE****F' mail a****@x.org tel ******3210")
