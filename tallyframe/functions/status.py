"""Synonym tables of the three status fields.

There are two sets: one is applied while reading a file, the other while normalising.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import strip

# The members of each status.
MEMBERS = {
    "kyc_status": ("VERIFIED", "PENDING", "FAILED", "EXEMPT", "UNKNOWN"),
    "fatca_status": ("COMPLIANT", "NON_COMPLIANT", "PENDING", "UNKNOWN"),
    "investor_status": ("ACTIVE", "INACTIVE", "SUSPENDED", "UNKNOWN"),
}

# Spellings understood when a file is read.
READ = {
    "kyc_status": {
        "VERIFIED": (
            "K", "KYC", "YES", "Y", "VALID", "OK", "VERIFIED", "COMPLIANT", "KRA COMPLIANT",
            "KRA-COMPLIANT", "KYC OK", "KYC VERIFIED", "KYC COMPLIANT", "COMPLIANT / VERIFIED",
            "KYC DONE", "KYC COMPLETE", "REGISTERED", "VALID KYC", "DONE",
        ),
        "PENDING": ("PENDING", "IN PROGRESS", "PROCESSING", "UNDER REVIEW", "SUBMITTED"),
        "FAILED": ("FAILED", "REJECTED", "INVALID", "NO", "N", "NOT VERIFIED", "NOT COMPLIANT"),
        "EXEMPT": ("EXEMPT", "EXEMPTED", "PAN EXEMPT", "MINOR EXEMPT"),
    },
    "fatca_status": {
        "COMPLIANT": ("C", "YES", "Y", "COMPLIANT", "FATCA COMPLIANT", "VALID", "OK", "DONE"),
        "NON_COMPLIANT": ("NON_COMPLIANT", "NON COMPLIANT", "NC", "NO", "N", "NOT COMPLIANT", "FAILED"),
        "PENDING": ("PENDING", "IN PROGRESS", "SUBMITTED"),
    },
    "investor_status": {
        "ACTIVE": ("A", "ACTIVE", "ENABLED", "LIVE", "YES", "Y"),
        "INACTIVE": ("I", "INACTIVE", "DISABLED", "CLOSED", "NO", "N"),
        "SUSPENDED": ("S", "SUSPENDED", "BLOCKED", "FROZEN", "DEACTIVATED"),
    },
}

# Spellings understood when a record is normalised.
NORMALIZE = {
    "kyc_status": {
        "VERIFIED": (
            "VERIFIED", "KYC VERIFIED", "OK", "COMPLIANT", "Y", "YES", "KYC COMPLIANT",
            "VERIFIED - KYC COMPLIANT",
        ),
        "PENDING": ("PENDING", "IN PROGRESS", "UNDER PROCESS", "SUBMITTED", "PROCESSING"),
        "FAILED": ("FAILED", "REJECTED", "NOT VERIFIED", "INVALID", "NO", "N"),
        "EXEMPT": ("EXEMPT", "KYC EXEMPT", "PAN EXEMPT"),
    },
    "fatca_status": {
        "COMPLIANT": ("COMPLIANT", "FATCA COMPLIANT", "YES", "Y", "OK"),
        "NON_COMPLIANT": ("NON_COMPLIANT", "NON-COMPLIANT", "NO", "N", "NOT COMPLIANT"),
        "PENDING": ("PENDING", "UNDER PROCESS", "PROCESSING"),
    },
    "investor_status": {
        "ACTIVE": ("ACTIVE", "LIVE", "Y", "YES", "ACTIVE STATUS"),
        "INACTIVE": ("INACTIVE", "CLOSED", "NO", "N"),
        "SUSPENDED": ("SUSPENDED", "BLOCKED", "FROZEN"),
    },
}


def _resolve(c: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    text = F.upper(strip(c))
    out = None
    for member, words in spellings.items():
        out = F.when(text.isin(*words), member) if out is None else out.when(text.isin(*words), member)
    return out.otherwise("UNKNOWN")


def read_status(c: Column, field: str) -> Column:
    """Status of a raw cell: a member name itself, else a known spelling, else UNKNOWN."""
    text = F.upper(strip(c))
    return F.when(text.isin(*MEMBERS[field]), text).otherwise(_resolve(c, READ[field]))


def normalize_status(c: Column, field: str) -> Column:
    return _resolve(c, NORMALIZE[field])
