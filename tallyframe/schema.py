"""Table layouts and the fixed vocabulary of the reconciliation data model."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 24 integer digits and 10 decimals: a difference of two such values is still exact.
AMOUNT = T.DecimalType(34, 10)

_S, _ARR = T.StringType(), T.ArrayType(T.StringType())

BASE = {
    "pan": _S,
    "investor_name": _S,
    "mobile": _S,
    "email": _S,
    "kyc_status": _S,
    "kyc_status_raw": _S,
    "fatca_status": _S,
    "investor_status": _S,
    "last_transaction_date": T.DateType(),
    "total_amount": AMOUNT,
    "total_amount_text": _S,
    "tax_status": _S,
    "is_minor_account": T.BooleanType(),
    "date_of_birth": _S,
    "bank_name": _S,
    "bank_account": _S,
    "ifsc": _S,
    "registered_address": _S,
    "mode_of_holding": _S,
    "nominee_1": _S,
    "nominee_relation": _S,
    "distributor_arn": _S,
}

CRM = {"crm_client_id": _S, "crm_order": T.LongType(), **BASE}

REPORT = {
    "source": _S,
    "file_name": _S,
    "file_id": _S,
    "file_path": _S,
    "folio_number": _S,
    "raw_row_index": T.LongType(),
    "missing_fields": _ARR,
    "empty_fields": _ARR,
    **BASE,
}

DLQ = {
    "stage": _S,
    "file_name": _S,
    "source": _S,
    "row_number": T.LongType(),
    "failure_type": _S,
    "field_name": _S,
    "message": _S,
    "raw_data": T.MapType(_S, _S),
}

DISCREPANCY = {
    "discrepancy_type": _S,
    "pan": _S,
    "field_name": _S,
    "crm_value": _S,
    "report_value": _S,
    "severity": _S,
    "explanation": _S,
    "source": _S,
    "source_info": T.MapType(_S, _S),
    "audit_trace": T.StructType(
        [
            T.StructField("matching_route", _S),
            T.StructField("match_confidence", T.DoubleType()),
            T.StructField("evaluation_timestamp", _S),
            T.StructField("reconciler_version", _S),
            T.StructField("rule_evaluated", _S),
            T.StructField("skipped_comparisons", _ARR),
        ]
    ),
}

FAILED_FILE = {"file_name": _S, "source": _S, "failure_type": _S, "message": _S}

STATUS_FIELDS = ("kyc_status", "fatca_status", "investor_status")

# The nine fields every stage inspects.
STANDARD_FIELDS = (
    "pan", "investor_name", "mobile", "email", "kyc_status", "fatca_status",
    "investor_status", "last_transaction_date", "total_amount",
)

EXTENDED_FIELDS = (
    "date_of_birth", "bank_name", "bank_account", "ifsc", "registered_address",
    "mode_of_holding", "nominee_1", "nominee_relation", "distributor_arn",
)


class Comparable(NamedTuple):
    """Naming of one comparable field: `<code>_MISMATCH`, `<code>_COMPARISON_SKIPPED`."""

    code: str
    label: str  # used in presence explanations
    sheet_label: str | None  # used in action lists and the field matrix


# Comparable fields in their comparison order.
COMPARABLE = {
    "pan": Comparable("PAN", "PAN", "PAN"),
    "investor_name": Comparable("NAME", "Investor Name", "Name"),
    "mobile": Comparable("MOBILE", "Mobile", "Mobile"),
    "email": Comparable("EMAIL", "Email", "Email"),
    "kyc_status": Comparable("KYC", "KYC Status", "KYC status"),
    "fatca_status": Comparable("FATCA", "FATCA Status", None),
    "investor_status": Comparable("STATUS", "Status", None),
    "last_transaction_date": Comparable("DATE", "Last Transaction Date", None),
    "total_amount": Comparable("AMOUNT", "Total Amount", "Total Amount"),
    "date_of_birth": Comparable("DOB", "Date of Birth", "Date of Birth"),
    "bank_name": Comparable("BANK", "Bank Name", "Bank name"),
    "bank_account": Comparable("BANK_ACCOUNT", "Bank Account", "Bank account"),
    "ifsc": Comparable("IFSC", "IFSC", "IFSC"),
    "registered_address": Comparable("ADDRESS", "Registered Address", "Registered address"),
    "mode_of_holding": Comparable("MODE_OF_HOLDING", "Mode of Holding", "Mode of holding"),
    "nominee_1": Comparable("NOMINEE", "Nominee 1", "Nominee 1"),
    "nominee_relation": Comparable("NOMINEE_RELATION", "Nominee Relation", "Nominee relation / %"),
    "distributor_arn": Comparable("DISTRIBUTOR_ARN", "Distributor (ARN)", "Distributor (ARN)"),
}

# Rows of the side-by-side field matrix, top to bottom.
MATRIX_FIELDS = (
    "investor_name", "pan", "email", "mobile", "date_of_birth", "bank_name", "bank_account",
    "ifsc", "registered_address", "mode_of_holding", "kyc_status", "nominee_1",
    "nominee_relation", "distributor_arn",
)

SOURCES = ("CAMS", "KFINTECH", "BSE", "NSE", "PDF_CAS", "INSURANCE")

RECONCILER_VERSION = "1.0.0"


def title_case(field: str) -> str:
    return field.replace("_", " ").title()


def skipped_note(field: str) -> str:
    known = COMPARABLE.get(field.strip().lower())
    return f"{known.code if known else field.upper()}_COMPARISON_SKIPPED"


def file_key(df: DataFrame) -> Column:
    """What tells the files of a table's rows apart: the full path, or folder and name where there is none."""
    file = F.concat_ws("/", "file_id", "file_name")
    return F.coalesce(F.col("file_path"), file) if "file_path" in df.columns else file


def struct_type(layout: dict) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in layout.items()])


def conform(df: DataFrame, layout: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select the columns of `layout` (absent ones become typed nulls) plus `keep`.

    Null status columns are UNKNOWN, absent presence lists are empty, and an absent
    amount text is taken from the amount.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    if not keep and list(have) == list(layout) and have == layout:
        return df

    def pick(name: str, dtype: T.DataType) -> str:
        if name in have:
            value = f"coalesce({name}, 'UNKNOWN')" if name in STATUS_FIELDS else name
        elif name == "total_amount_text" and "total_amount" in have:
            value = "total_amount"
        elif name in STATUS_FIELDS:
            value = "'UNKNOWN'"
        else:
            value = {"missing_fields": "array()", "empty_fields": "array()", "is_minor_account": "false"}.get(name, "NULL")
        return f"CAST({value} AS {dtype.simpleString()}) AS {name}"

    return df.selectExpr(*[pick(n, t) for n, t in layout.items()], *keep)
