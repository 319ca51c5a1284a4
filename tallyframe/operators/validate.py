"""Profile-driven validation: every failure of a row, then the split into valid and invalid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.config import Profiles, Validation
from tallyframe.functions import normalize as N
from tallyframe.functions.text import blank, or_none
from tallyframe.schema import STANDARD_FIELDS, STATUS_FIELDS

# Statuses accepted when the configuration lists none.
ALLOWED = {
    "kyc_status": ("VERIFIED", "EXEMPT", "PENDING"),
    "fatca_status": ("COMPLIANT", "NON_COMPLIANT", "PENDING"),
    "investor_status": ("ACTIVE", "INACTIVE", "SUSPENDED"),
}


def pan_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(N.PAN_FORMAT), F.lit(False))


def mobile_ok(c: Column) -> Column:
    return F.coalesce(N.valid_mobile(c), F.lit(False))


def email_ok(c: Column) -> Column:
    return F.coalesce(N.valid_email(c), F.lit(False))


def status_ok(c: Column, field: str, allowed: Iterable[str] = ()) -> Column:
    return F.coalesce(c.isin(*(tuple(allowed) or ALLOWED[field])), F.lit(False))


def populated(field: str) -> Column:
    """Carries a value: zero amounts and UNKNOWN statuses do not count."""
    c = F.col(field)
    if field == "total_amount":
        return c.isNotNull() & (c != 0)
    if field == "last_transaction_date":
        return c.isNotNull()
    if field in STATUS_FIELDS:
        return ~blank(c) & (c != "UNKNOWN")
    return ~blank(c)


def _failure(failure_type: str, field: str, message: Column) -> Column:
    return F.struct(
        F.lit(failure_type).alias("failure_type"), F.lit(field).alias("field_name"), message.alias("message")
    )


def _required(df: DataFrame, profiles: Profiles) -> list[Column]:
    types = dict(df.dtypes)
    out = []
    for f in profiles.names("required_fields"):
        absent = F.lit(True) if f not in types else blank(F.col(f)) if types[f] == "string" else F.col(f).isNull()
        out.append(
            F.when(profiles.lists("required_fields", f) & absent,
                   _failure("REQUIRED_FIELD_MISSING", f, F.lit(f"Required field '{f}' is missing or empty.")))
        )
    return out


def _unexpected(df: DataFrame, profiles: Profiles) -> list[Column]:
    return [
        F.when(populated(f) & ~profiles.lists("available_fields", f),
               _failure("UNEXPECTED_FIELD", f,
                        F.lit(f"Field '{f}' is populated but not listed in available_fields for this source.")))
        for f in STANDARD_FIELDS
        if f in df.columns
    ]


def _formats(df: DataFrame, profiles: Profiles, limits: Validation) -> list[Column]:
    def quoted(lead: str, field: str, tail: str) -> Column:
        return F.concat(F.lit(f"{lead} '"), or_none(F.col(field)), F.lit(f"' {tail}"))

    allowed = {"kyc_status": limits.allowed_kyc_statuses, "fatca_status": limits.allowed_fatca_statuses}
    tests = [
        ("pan", "INVALID_PAN_FORMAT", ("pan_format",), ~pan_ok(F.col("pan")),
         quoted("PAN", "pan", "failed regex formatting verification.")),
        ("mobile", "INVALID_MOBILE_FORMAT", ("mobile_format",),
         F.col("mobile").isNotNull() & ~mobile_ok(F.col("mobile")) if "mobile" in df.columns else None,
         quoted("Mobile", "mobile", "is not a valid 10-digit number.")),
        ("email", "INVALID_EMAIL_FORMAT", ("email_format",),
         F.col("email").isNotNull() & ~email_ok(F.col("email")) if "email" in df.columns else None,
         quoted("Email", "email", "has invalid email syntax.")),
        ("kyc_status", "INVALID_KYC_STATUS", ("kyc_status", "kyc_status_format"), None,
         quoted("KYC status", "kyc_status", "is not in allowed KYC statuses.")),
        ("fatca_status", "INVALID_FATCA_STATUS", ("fatca_status", "fatca_status_format"), None,
         quoted("FATCA status", "fatca_status", "is not in allowed FATCA statuses.")),
        ("investor_status", "INVALID_INVESTOR_STATUS", ("investor_status", "investor_status_format"), None,
         quoted("Investor status", "investor_status", "is invalid.")),
    ]
    out = []
    for field, kind, rules, wrong, message in tests:
        if field not in df.columns:
            continue
        if field in STATUS_FIELDS:
            wrong = ~status_ok(F.col(field), field, allowed.get(field, ()))
        out.append(F.when(profiles.lists("validations", *rules) & wrong, _failure(kind, field, message)))
    return out


def with_failures(
    df: DataFrame,
    profiles: Profiles,
    limits: Validation = Validation(),
    checks: Iterable[str] = ("required", "unexpected", "format"),
) -> DataFrame:
    """Add `failures`, the array of all rule failures of the row, in rule order.

    `limits` narrows the accepted KYC and FATCA statuses where it lists any.
    """
    parts = {
        "required": lambda: _required(df, profiles),
        "unexpected": lambda: _unexpected(df, profiles),
        "format": lambda: _formats(df, profiles, limits),
    }
    failures = [f for check in checks for f in parts[check]()]
    return df.withColumn("failures", F.array_compact(F.array(*failures)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a failure, and rows with at least one."""
    failed = F.size("failures") > 0
    return df.filter(~failed).drop("failures"), df.filter(failed)


def explode_failures(df: DataFrame) -> DataFrame:
    """One row per failure of an invalid row."""
    return df.select("*", F.posexplode("failures").alias("failure_no", "_f")).select(
        *[c for c in df.columns if c != "failures"], "failure_no", "_f.*"
    )
