"""From raw string columns to typed records: split columns, coercion, presence, row rejection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.normalize import valid_email
from tallyframe.functions.status import read_status
from tallyframe.functions.text import blank, collapse, strip
from tallyframe.schema import AMOUNT, CRM, EXTENDED_FIELDS, REPORT, STANDARD_FIELDS, STATUS_FIELDS, conform
from tallyframe.sources.catalog import Aliases, aliases_of, map_headers
from tallyframe.storage import spread

# Columns a scan adds to the file's own.
PLACE = ("_row", "_file_name", "_file_id", "_file_path")

# Cells read as missing, and texts that mean "no value" in string fields.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
NO_VALUE = ("", "nan", "none", "n/a", "-")


def null_missing(c: Column) -> Column:
    """A cell a table reader takes as missing becomes null."""
    return F.when(~c.isin(*MISSING_CELLS), c)


# Fixed values: (new column, present if any of these, taken from the first of these).
_COPIES = (
    ("PAN", ("pan", "pannumber", "panno"), ("primary holder pan", "primary holder pan no")),
    ("Mobile", ("mobile", "mobilenumber", "phone", "contactnumber"),
     ("indian mobile no.", "indian mobile no", "indianmobileno")),
    ("Bank Name", ("bank", "bankname", "bank_name"), ("bank name 1", "bankname1")),
    ("Account No", ("account no", "account_no", "bank_account", "ac_no"), ("account no 1", "accountno1")),
    ("IFSC", ("ifsc", "ifsc_code", "ifsccode"), ("ifsc code 1", "ifsccode1")),
    ("Mode of Holding", ("mode", "mode_of_holding", "holding_mode"), ("holding nature", "holdingnature")),
    ("KYC Status", ("kyc", "kycstatus", "kyc_status"), ("primary holder kyc type", "primaryholderkyctype")),
    ("Date of Birth", ("dob", "date_of_birth", "birthdate"),
     ("primary holder dob/incorporation", "primary holder dob")),
)
_NAME_PRESENT = ("name", "investor name", "investorname", "clientname", "fullname", "customer name")
_NAME_PARTS = tuple(
    (f"primary holder {w} name", f"{w} name", f"{w}name", f"{w}_name") for w in ("first", "middle", "last")
)
_ADDRESS_PRESENT = ("address", "registered_address", "residence_address")
_ADDRESS_PARTS = ("address 1", "address 2", "address 3", "city", "state", "pincode")
_RELATION_PRESENT = ("nominee_relation", "relation", "nominee_relationship")
_RELATION = ("nominee 1 relationship",)
_SHARE = ("nominee 1 applicable(%)", "nominee 1 applicable (%)", "nominee1applicable")


def split_columns(cells: dict[str, Column]) -> dict[str, Column]:
    """Cells to add where a layout spreads one field over several of its own columns.

    Both sides map a header to its cell.
    """
    by_text = {header.lower().strip(): header for header in cells}

    def first(names: Iterable[str]) -> str | None:
        return next((by_text[n] for n in names if n in by_text), None)

    def text(column: str) -> Column:
        return F.nullif(strip(F.coalesce(cells[column], F.lit(""))), F.lit(""))

    out: dict[str, Column] = {}
    first_name, middle, last = (first(names) for names in _NAME_PARTS)
    if not first(_NAME_PRESENT) and first_name and last:
        out["Investor Name"] = collapse(F.concat_ws(" ", *[text(c) for c in (first_name, middle, last) if c]))
    for target, present, origins in _COPIES:
        origin = first(origins)
        if origin and not first(present):
            out[target] = cells[origin]
    address = [by_text[n] for n in _ADDRESS_PARTS if n in by_text]
    if address and not first(_ADDRESS_PRESENT):
        parts = [F.when(F.lower(text(c)) != "nan", text(c)) for c in address]
        out["Registered Address"] = F.regexp_replace(F.concat_ws(", ", *parts), "^[, ]+|[, ]+$", "")
    relation, share = first(_RELATION), first(_SHARE)
    if (relation or share) and not first(_RELATION_PRESENT):
        parts = [text(relation)] if relation else []
        if share:
            parts.append(F.concat(text(share), F.lit("%")))
        out["Nominee Relation"] = F.concat_ws(" / ", *parts)
    return out


def clean_text(c: Column) -> Column:
    """Trimmed text; null tokens become null and whole numbers lose a `.0` a spreadsheet added."""
    text = strip(c)
    text = F.when(~F.lower(text).isin(*NO_VALUE), text)
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def parse_amount(c: Column) -> Column:
    return strip(F.regexp_replace(c, ",", "")).try_cast(AMOUNT)


def surrogate_id(row_index: Column) -> Column:
    """Stand-in client id of a master row without one."""
    return F.concat(F.lit("AUTO_GEN_"), F.substring(F.md5(row_index.cast("string")), 1, 8))


def is_minor(tax_status: Column) -> Column:
    return F.coalesce(F.upper(tax_status).contains("MINOR"), F.lit(False))


def empty_fields(cells: dict[str, Column]) -> Column:
    """Names of the given standard fields whose cell is blank."""
    return F.array_compact(
        F.array(*[F.when(blank(cells[f]), F.lit(f)) for f in STANDARD_FIELDS if f in cells])
    ).cast("array<string>")


def missing_fields(present: Iterable[str]) -> Column:
    """Names of the standard fields a file has no column for."""
    present = set(present)
    return F.array(*[F.lit(f) for f in STANDARD_FIELDS if f not in present]).cast("array<string>")


def reject_reasons(kind: str, amount_cell: Column | None) -> Column:
    """Reasons to reject a parsed row, empty if it is accepted.

    A missing PAN or name is reported alone; otherwise each field of the wrong type is named.
    """
    absent = F.array_compact(
        F.array(F.when(F.col("pan").isNull(), F.lit("PAN")), F.when(F.col("investor_name").isNull(), F.lit("Investor Name")))
    )
    typed = [
        F.when(~valid_email(F.col("email")), F.lit("email: value is not a valid email address")),
    ]
    if amount_cell is not None:
        typed.append(
            F.when(amount_cell.isNull(),
                   F.lit("total_amount: Decimal input should be an integer, float, string or Decimal object"))
            .when(F.col("total_amount").isNull(), F.lit("total_amount: Input should be a valid decimal"))
            # refused by name: a rounded value could pass or fail a strict comparison wrongly
            .when(amount_cell.rlike(r"\.[0-9]{10}[0-9]*[1-9]"), F.lit("total_amount: more than 10 decimals"))
        )
    if kind == "CRM":
        typed.append(F.when(F.col("crm_client_id").isNull(), F.lit("crm_client_id: Input should be a valid string")))
    return F.when(
        F.size(absent) > 0, F.array(F.concat(F.lit("Missing required fields: "), F.array_join(absent, ", ")))
    ).otherwise(F.array_compact(F.array(*typed)))


def parse_table(
    raw: DataFrame, source: str, aliases: Aliases | None = None, headers: list[str] | None = None
) -> DataFrame:
    """Typed rows of one layout, with `reasons` (empty when accepted) and `raw_data`.

    `raw` has the string columns of the file, in order, plus `_row` (0-based data row),
    `_file_name`, `_file_id` and, if known, `_file_path` and `_beyond` (cells after the last header, which
    reject the row). `headers` names them where the column names of `raw` do not.
    `source` is "CRM" for the master.
    """
    if "_file_path" not in raw.columns:
        raw = raw.withColumn("_file_path", F.lit(None).cast("string"))
    own = [c for c in raw.columns if c not in (*PLACE, "_beyond")]
    headers = headers or own
    beyond = F.col("_beyond") if "_beyond" in raw.columns else F.lit(None).cast("string")
    numbered = spread(raw, "_file_path", "_file_id", "_file_name", "_row").select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], beyond.alias("_beyond"), *PLACE)
    found = {h: null_missing(F.col(f"_c{i}")) for i, h in enumerate(headers)}
    found |= split_columns(found)
    mapping = map_headers(found, aliases or aliases_of(source))
    allowed = set(CRM if source == "CRM" else REPORT) - {"source", "file_name", "file_id", "file_path", "raw_row_index"}
    spare = {h: h for h in found if h in allowed and h not in mapping and h not in mapping.values()}
    cells = {f: found[h] for f, h in {**spare, **mapping}.items()}

    fields = {
        "raw_data": F.map_from_arrays(F.array(*[F.lit(h) for h in found]), F.array(*found.values())),
        "missing_fields": missing_fields(mapping),
        "empty_fields": empty_fields({f: found[h] for f, h in mapping.items()}),
        "mobile": F.lit(None).cast("string"),
        "email": F.lit(None).cast("string"),
        "folio_number": F.lit(None).cast("string"),
    }
    for f in ("pan", "investor_name", "mobile", "email", "folio_number", "tax_status", *EXTENDED_FIELDS):
        if f in cells and f in allowed:
            fields[f] = clean_text(cells[f])
    for f in STATUS_FIELDS:
        fields[f] = read_status(cells[f], f) if f in cells else F.lit("UNKNOWN")
    if "kyc_status" in cells:
        fields["kyc_status_raw"] = strip(cells["kyc_status"])
    fields["is_minor_account"] = is_minor(cells["tax_status"]) if "tax_status" in mapping else F.lit(False)
    fields["total_amount"] = F.lit(0).cast(AMOUNT)
    fields["total_amount_text"] = F.lit("0.00")
    amount_cell = cells.get("total_amount")
    if amount_cell is not None:
        fields["total_amount"] = parse_amount(amount_cell)
        fields["total_amount_text"] = strip(F.regexp_replace(amount_cell, ",", ""))
        fields["_amount_cell"] = amount_cell
    if source == "CRM":
        given = cells.get("crm_client_id", F.lit(None).cast("string"))
        fields["crm_client_id"] = F.when(given.isNull(), surrogate_id(F.col("_row"))).otherwise(clean_text(given))
        fields["crm_order"] = F.col("_row")
    else:
        fields["source"] = F.lit(source)
        fields["raw_row_index"] = F.col("_row") + 2
    fields |= {"file_name": F.col("_file_name"), "file_id": F.col("_file_id"), "file_path": F.col("_file_path"),
               "row_number": F.col("_row") + 2, "_beyond": F.col("_beyond")}

    too_long = F.array(F.lit(f"Expected {len(headers)} cells, the row has more"))
    reasons = reject_reasons(source, None if amount_cell is None else F.col("_amount_cell"))
    typed = numbered.select(*[c.alias(n) for n, c in fields.items()]).withColumn(
        "reasons", F.when(F.col("_beyond").isNotNull(), too_long).otherwise(reasons))
    if source == "CRM":
        return conform(typed, CRM, ("file_name", "file_id", "file_path", "row_number", "raw_data", "reasons"))
    return conform(typed, REPORT, ("row_number", "raw_data", "reasons"))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with `reason`."""
    rejected = F.size("reasons") > 0
    return (
        parsed.filter(~rejected).drop("reasons"),
        parsed.filter(rejected).withColumn("reason", F.array_join("reasons", "; ")).drop("reasons"),
    )
