"""Normalisation of parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import normalize as N
from tallyframe.functions.status import normalize_status
from tallyframe.schema import EXTENDED_FIELDS, STATUS_FIELDS

# Dropped when only the core fields are kept.
_CARRIED = ("kyc_status_raw", "tax_status", "is_minor_account", "missing_fields", "empty_fields", *EXTENDED_FIELDS)


def normalize(df: DataFrame, keep_extended: bool = True) -> DataFrame:
    """Normalise every field in place and add `norm_error`, the first refusal or null.

    `keep_extended=False` also clears the extended fields, the raw KYC text, the tax status and
    the presence lists, as a run that rebuilds records from their core fields does.
    """
    has = set(df.columns)
    exact = F.col("total_amount")
    text_amount = dict(df.dtypes)["total_amount"] == "string" if "total_amount" in has else False
    out = {
        "pan": N.pan(F.col("pan")),
        "investor_name": N.name(F.col("investor_name")),
        "mobile": N.mobile(F.col("mobile")),
        "email": N.email(F.col("email")),
        **{f: normalize_status(F.col(f), f) for f in STATUS_FIELDS},
        "total_amount": N.amount(exact) if text_amount else F.coalesce(exact, F.lit(0).cast(dict(df.dtypes).get("total_amount", "int"))),
    }
    errors = [N.pan_error(F.col("pan"))]
    if "mobile" in has:
        errors.append(N.mobile_error(F.col("mobile")))
    if "email" in has:
        errors.append(N.email_error(F.col("email")))
    if text_amount:
        errors.append(N.amount_error(exact))
    out = {name: column for name, column in out.items() if name in has}
    if not keep_extended:
        for f in df.schema.fields:
            if f.name in _CARRIED:
                empty = {"missing_fields": F.array().cast(f.dataType), "empty_fields": F.array().cast(f.dataType),
                         "is_minor_account": F.lit(False)}
                out[f.name] = empty.get(f.name, F.lit(None).cast(f.dataType))
    return df.withColumns({**out, "norm_error": F.coalesce(*errors)})


def split_normalized(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and refused ones."""
    return df.filter(F.col("norm_error").isNull()).drop("norm_error"), df.filter(F.col("norm_error").isNotNull())
