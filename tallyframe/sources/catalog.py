"""What is known about each source: header aliases, detection words, and user registrations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tallyframe.errors import ParserError, SchemaMismatchError

Aliases = Mapping[str, tuple[str, ...]]

# Header spellings, best first. Case, blanks and punctuation do not matter.
_EXTENDED: Aliases = {
    "tax_status": ("tax status", "taxability", "tax category", "tax status desc"),
    "date_of_birth": ("date of birth", "dob", "birth date"),
    "bank_name": ("bank name", "bank"),
    "bank_account": ("bank account", "bank account number", "account no", "account number", "bank ac", "ac no", "ac number"),
    "ifsc": ("ifsc", "ifsc code"),
    "registered_address": ("registered address", "address", "residence address"),
    "mode_of_holding": ("mode of holding", "holding mode", "mode", "holding type"),
    "nominee_1": ("nominee", "nominee 1", "nominee name"),
    "nominee_relation": ("nominee relation", "nominee relation percentage", "relation", "nominee relationship"),
    "distributor_arn": ("distributor arn", "arn", "distributor", "broker code", "broker arn"),
}


def _exchange(code: str) -> Aliases:
    """Layout of the two exchanges, which prefix some headers with their own code."""
    return {
        "pan": (f"{code} pan", "pan", "pan number", "pan no", "primary holder pan"),
        "investor_name": ("name", "investor name", "client name", f"{code} client name"),
        "mobile": ("mobile", "mobile number", "contact number", "phone", "indian mobile no"),
        "email": ("email", "email address"),
        "total_amount": ("amount", "total amount", "balance"),
        "folio_number": ("folio number", "folio", "folio no", "client code", "code", "client id", f"{code} client code"),
        "kyc_status": ("kyc", "kyc status", "primary holder kyc type"),
        **_EXTENDED,
        "date_of_birth": (*_EXTENDED["date_of_birth"], "primary holder dob/incorporation", "primary holder dob"),
        "bank_name": (*_EXTENDED["bank_name"], "bank name 1"),
        "bank_account": (*_EXTENDED["bank_account"], "account no 1"),
        "ifsc": (*_EXTENDED["ifsc"], "ifsc code 1"),
        "registered_address": (*_EXTENDED["registered_address"], "address 1"),
        "mode_of_holding": (*_EXTENDED["mode_of_holding"], "holding nature"),
        "nominee_1": (*_EXTENDED["nominee_1"], "nominee 1 name"),
        "nominee_relation": (*_EXTENDED["nominee_relation"], "nominee 1 relationship"),
    }


ALIASES: dict[str, Aliases] = {
    "CRM": {
        "pan": ("pan", "pan number", "pan no", "permanent account number", "pan card number", "pan card"),
        "investor_name": ("name", "investor name", "client name", "full name", "customer name"),
        "mobile": ("mobile", "mobile number", "contact number", "phone", "phone number"),
        "email": ("email", "email address"),
        "kyc_status": ("kyc", "kyc status", "kyc compliance"),
        "fatca_status": ("fatca", "fatca status", "fatca compliance"),
        "investor_status": ("status", "investor status", "client status", "current status"),
        "total_amount": ("amount", "total amount", "balance", "holding balance"),
        "crm_client_id": ("crm client id", "client id", "crm id", "id"),
        **_EXTENDED,
    },
    "CAMS": {
        "pan": ("pan", "pan number", "pan no", "permanent account number"),
        "investor_name": ("name", "investor name", "client name"),
        "mobile": ("mobile", "mobile number", "contact number", "phone", "phone number"),
        "email": ("email", "email address"),
        "kyc_status": ("kyc", "kyc status", "kyc compliance"),
        "fatca_status": ("fatca", "fatca status", "fatca compliance"),
        "investor_status": ("status", "investor status", "client status"),
        "total_amount": ("amount", "total amount", "balance", "holding balance"),
        "folio_number": ("folio", "folio number", "folio no"),
        **_EXTENDED,
    },
    "KFINTECH": {
        "pan": ("pan no", "pan", "pan number"),
        "investor_name": ("name", "investor name", "client name"),
        "mobile": ("mobile", "mobile number", "contact number", "phone"),
        "email": ("email", "email address"),
        "kyc_status": ("kyc", "kyc status"),
        "fatca_status": ("fatca", "fatca status"),
        "investor_status": ("status", "investor status"),
        "total_amount": ("amount", "total amount", "balance"),
        "folio_number": ("folio", "folio number", "folio no"),
        **_EXTENDED,
    },
    "BSE": _exchange("bse"),
    "NSE": _exchange("nse"),
    "INSURANCE": {
        "pan": ("pan", "pan number", "pan no", "policyholder pan", "insurance pan"),
        "investor_name": ("name", "investor name", "client name", "policyholder", "insured name", "insurance client name"),
        "mobile": ("mobile", "mobile number", "contact number", "phone"),
        "email": ("email", "email address"),
        "total_amount": ("amount", "premium", "sum assured", "total amount", "balance", "value"),
        "folio_number": ("policy number", "policy no", "folio", "folio number"),
        **_EXTENDED,
        "tax_status": ("tax status", "taxability", "tax category"),
    },
}


@dataclass(frozen=True)
class Signature:
    """Words that give a source away; the first signature that hits wins."""

    source: str
    in_headers: tuple[str, ...] = ()
    in_file_name: tuple[str, ...] = ()


# Order matters.
SIGNATURES: list[Signature] = [
    Signature("INSURANCE", ("insurance", "policy"), ("insurance", "policy")),
    Signature("KFINTECH", ("kfin", "karvy"), ("kfintech", "mfsd211")),
    Signature("BSE", ("bse",), ("bse",)),
    Signature("NSE", ("nse",), ("nse",)),
    Signature("CAMS", ("cams",), ("cams",)),
    Signature("CAMS", ("folio",)),
]

# Words in sheet names, in order.
SHEET_WORDS: list[tuple[str, tuple[str, ...]]] = [
    ("INSURANCE", ("insurance", "policy")),
    ("CAMS", ("cams",)),
    ("KFINTECH", ("kfin", "karvy")),
    ("BSE", ("bse",)),
    ("NSE", ("nse",)),
]


@dataclass(frozen=True)
class Reader:
    """How the files of a source with a format of their own are read."""

    source: str
    data_source: type[DataSource]


# By the suffix of the files.
READERS: dict[str, Reader] = {}


def register_source(
    name: str, aliases: Aliases, in_headers: Iterable[str] = (), in_file_name: Iterable[str] = (),
    data_source: type[DataSource] | None = None, suffixes: Iterable[str] = (),
) -> None:
    """Teach the engine a further source: its headers, and the words that identify its files.

    Files of a format of their own are known by their `suffixes` and read by `data_source`, a Spark data
    source in Python. It is given the paths as option `paths`, a JSON list, and has a text column per
    header, `_row` (bigint, the number of the data row in its file from 0 on) and `_file_path`. Its
    partitions are the tasks of the scan.
    """
    name = name.upper().strip()
    ALIASES[name] = dict(aliases)
    if data_source is not None:
        READERS.update({s.lower(): Reader(name, data_source) for s in suffixes})
    words = tuple(w.lower() for w in in_headers), tuple(w.lower() for w in in_file_name)
    if any(words):
        SIGNATURES.insert(0, Signature(name, *words))


def aliases_of(name: str) -> Aliases:
    name = name.upper().strip()
    if name not in ALIASES:
        raise ParserError(f"No parser registered for source: {name}")
    return ALIASES[name]


def squeeze(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", header.strip().lower())


def map_headers(columns: Iterable[str], aliases: Aliases) -> dict[str, str]:
    """Field -> column. Of two columns that read alike the later one counts; a column wanted by
    two fields goes to the later field. PAN and name must be found."""
    by_text = {squeeze(c): c for c in columns}
    owner: dict[str, str] = {}
    for target, spellings in aliases.items():
        column = next((by_text[squeeze(s)] for s in spellings if squeeze(s) in by_text), None)
        if column is not None:
            owner[column] = target
    fields = {target: column for column, target in owner.items()}
    needed = {"pan": "PAN", "investor_name": "Investor Name"}
    missing = [label for target, label in needed.items() if target not in fields]
    if missing:
        raise SchemaMismatchError(f"Missing required columns: {', '.join(missing)}")
    return fields


def _mentions(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def source_from_headers(headers: Column, file_name: Column) -> Column:
    """Source by signature, null if none fits. `headers` is an array of strings."""
    text, name = F.lower(F.array_join(headers, " ")), F.lower(file_name)
    out = F
    for s in SIGNATURES:
        out = out.when(_mentions(text, s.in_headers) | _mentions(name, s.in_file_name), F.lit(s.source))
    return out


def source_from_sheets(sheets: Column) -> Column:
    """Source by the first sheet whose name hits, null if none does."""
    def of(sheet: Column) -> Column:
        out = F
        for source, words in SHEET_WORDS:
            out = out.when(_mentions(F.lower(sheet), words), F.lit(source))
        return out

    return F.get(F.array_compact(F.transform(sheets, of)), F.lit(0))


def reader_of(file_name: str) -> Reader | None:
    return next((r for s, r in READERS.items() if file_name.lower().endswith(s)), None)


def suffix_of(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"(\.[^./\\]+)$", 1))


def detect_source(file_name: Column, headers: Column, sheets: Column) -> Column:
    """Source of a file by extension, then sheet names, then headers and file name."""
    suffix = suffix_of(file_name)
    return (
        F.when(suffix == ".pdf", F.lit("PDF_CAS"))
        .when(suffix == ".csv", source_from_headers(headers, file_name))
        .when(suffix.isin(".xlsx", ".xls"),
              F.coalesce(source_from_sheets(sheets), source_from_headers(headers, file_name)))
    )


def detection_failure(file_name: Column) -> Column:
    suffix = suffix_of(file_name)
    return F.when(
        ~suffix.isin(".pdf", ".csv", ".xlsx", ".xls"),
        F.concat(F.lit("Unsupported extension for auto-detection: "), suffix),
    ).otherwise(F.concat(F.lit("Could not auto-detect report source for file: "), file_name))
