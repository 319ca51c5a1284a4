"""Presentation of results: labels, field matrix, action list, search, redaction, extracts."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import ReconConfig
from tallyframe.functions import normalize as N
from tallyframe.functions.text import collapse, lookup, strip
from tallyframe.operators.compare import PLACE, compare_profiles, severity, _differing_fields
from tallyframe.operators.skew import attach, first_row, fits_broadcast
from tallyframe.schema import COMPARABLE, MATRIX_FIELDS, file_key

# How sources are called in result sheets, and the order of their columns.
SOURCE_LABEL = {
    "BSE": "BSE", "NSE": "NSE", "KFINTECH": "CAMS/KFintech", "CAMS": "CAMS/KFintech",
    "INSURANCE": "SOA", "PDF_CAS": "CAS",
}
COLUMN_RANK = {"PDF_CAS": "0", "BSE": "1", "NSE": "2", "KFINTECH": "3", "CAMS": "4", "INSURANCE": "5"}

SEVERITY_RANK = {"CRITICAL": "1", "HIGH": "2", "MEDIUM": "3", "LOW": "4"}

# Recommended actions by discrepancy type.
_BANK = "Verify bank details against a cancelled cheque and update incorrect records."
_NOMINEE = "Update nominee details in CRM or RTA records to match the latest registered nomination."
_DUPLICATE = (
    "Investigate duplicate PAN. Address belongs to a different family member."
    " Deactivate/merge into clean code."
)
ACTION = {
    "EMAIL_MISMATCH": "Update CRM email to the registered ID, or confirm which is the intended contact.",
    "MOBILE_MISMATCH": "Update CRM mobile to the registered number, or confirm intended contact.",
    "DOB_MISMATCH": "Likely day/month swap on folios. Verify against PAN/KYC and raise correction if wrong.",
    "DUPLICATE_RECORD": _DUPLICATE,
    "CONFLICTING_DUPLICATE": _DUPLICATE,
    "EXACT_DUPLICATE": _DUPLICATE,
    "ADDRESS_MISMATCH": "Verify registered address and update CRM if investor has changed address.",
    "BANK_MISMATCH": _BANK,
    "BANK_ACCOUNT_MISMATCH": _BANK,
    "IFSC_MISMATCH": _BANK,
    "NOMINEE_MISMATCH": _NOMINEE,
    "NOMINEE_RELATION_MISMATCH": _NOMINEE,
    "MISSING_IN_CRM": "Create new client profile in CRM for this investor using details from RTA report.",
    "NAME_MISMATCH": "Verify legal name in PAN card and align CRM and RTA systems.",
}
OTHER_ACTION = "Verify discrepancy details between CRM and report file and correct the mismatch."

# Spellings that count as the same status when values are shown side by side.
KYC_DONE = ("verified", "yes", "valid", "kra compliant", "kyc ok", "compliant", "compliant / verified", "ok")
HELD_SINGLY = ("single", "individual", "individual / single", "single / individual")

ABSENT, DASH = "(not in row)", "—"
NO_DUPLICATES = "No duplicates — deactivate/merge"


def source_label(source: Column) -> Column:
    return F.coalesce(lookup(source, SOURCE_LABEL), source)


def file_label(source: Column, file_name: Column, several: Column) -> Column:
    """Source label, with the file stem added where `several` files come from that source."""
    base = source_label(source)
    stem = collapse(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_", " "))
    plain = strip(F.replace(F.replace(F.lower(stem), F.lower(base)), F.lit("master")))
    short = F.when(F.contains(F.lower(stem), F.lower(base)) & (plain != ""), plain).otherwise(stem)
    named = F.concat(base, F.lit(" ("), F.initcap(collapse(short)), F.lit(")"))
    return F.when(several & (F.coalesce(stem, F.lit("")) != ""), named).otherwise(base)


def label_files(files: DataFrame) -> DataFrame:
    """Add `column_label` to a table with one row per (source, file_name)."""
    counts = files.groupBy("source").agg(F.count_distinct("file_name").alias("_n"))
    return files.join(counts, "source").withColumn(
        "column_label",
        file_label(F.col("source"), F.col("file_name"), (F.col("_n") > 1) & (F.col("source") != "PDF_CAS")),
    ).drop("_n")


def code_suffix(folio: Column) -> Column:
    """Client code behind a label; folios with a slash are no codes."""
    code = strip(F.coalesce(folio, F.lit("")))
    shown = (code != "") & (code != "N/A") & ~code.contains("/")
    return F.when(shown, F.concat(F.lit(" (code "), code, F.lit(")"))).otherwise("")


def source_from_file_name(file_name: Column) -> Column:
    """Source a file name suggests, CRM if none."""
    name = F.lower(file_name)
    return (
        F.when(name.contains("bse"), "BSE").when(name.contains("nse"), "NSE")
        .when(name.rlike("kfin|mfsd|karvi"), "KFINTECH")
        .when(name.rlike(r"cams|\.xls$") | (name.endswith(".xlsx") & name.contains("rta")), "CAMS")
        .when(name.contains("insurance"), "INSURANCE").otherwise("CRM")
    )


def discrepancy_column() -> Column:
    """Label of the result column a discrepancy belongs to: by its file name, else by its source."""
    name = F.lower(F.coalesce("file_name", F.lit("")))
    rule = F.upper("audit_trace.rule_evaluated")
    return (
        F.when(name.contains("bse"), "BSE").when(name.contains("nse"), "NSE")
        .when(name.rlike("cams|kfin|mfsd"), "CAMS/KFintech")
        .when(name.contains("insurance"), "SOA")
        .when(name.contains("cas") | name.endswith(".pdf"), "CAS")
        .when(rule.contains("BSE"), "BSE").when(rule.contains("NSE"), "NSE")
        .when(rule.rlike("CAMS|KFIN"), "CAMS/KFintech")
        .when(rule.rlike("INSURANCE|SOA"), "SOA")
        .when(rule.contains("CAS"), "CAS")
    )


def field_label(field: Column) -> Column:
    known = {f: c.sheet_label for f, c in COMPARABLE.items() if c.sheet_label}
    return F.coalesce(lookup(field, known), F.initcap(F.replace(field, F.lit("_"), F.lit(" "))), F.lit(""))


def values_match(df: DataFrame, a: str, b: str, field: str | Column, name: str) -> DataFrame:
    """Add `name`: whether the texts of columns `a` and `b` mean the same although they may be
    written differently. `field` is a field name, or a column of names.

    The steps are separate columns, so that each regular expression runs once per row.
    """
    of = F.lit(field) if isinstance(field, str) else field
    own = df.columns
    steps = df.withColumns({"_s": strip(F.col(a)), "_t": strip(F.col(b))})
    steps = steps.withColumns({
        f"_{kind}_{c}": build(F.col(f"_{c}"))
        for c in ("s", "t")
        for kind, build in {
            "low": F.lower,
            "number": lambda x: F.regexp_replace(x, ",", "").try_cast("double"),
            "digits": lambda x: F.right(F.regexp_replace(x, r"\D", ""), F.lit(10)),
            "day": N.date,
        }.items()
    })

    def both(kind: str) -> tuple[Column, Column]:
        return F.col(f"_{kind}_s"), F.col(f"_{kind}_t")

    low, number, digits, day = both("low"), both("number"), both("digits"), both("day")
    near = F.coalesce(F.abs(number[0] - number[1]) < 0.01, F.lit(False))
    same_day = F.coalesce(number[0].isNull() & number[1].isNull() & (day[0] == day[1]), F.lit(False))
    names = of.isin("investor_name", "nominee_1") & (collapse(low[0]) == collapse(low[1]))
    kyc = (of == "kyc_status") & low[0].isin(*KYC_DONE) & low[1].isin(*KYC_DONE)
    held = [F.rtrim(x, F.lit(".")).isin(*HELD_SINGLY) for x in low]
    same = (
        F.when(F.col(a).eqNullSafe(F.col(b)), True)
        .when(F.col(a).isNull() | F.col(b).isNull(), False)
        .when(low[0] == low[1], True)
        .when((of == "mobile") & (digits[0] != "") & (digits[1] != ""), digits[0] == digits[1])
        .when(of == "bank_account", F.ltrim(F.col("_s"), F.lit("0")) == F.ltrim(F.col("_t"), F.lit("0")))
        .otherwise(near | same_day | names | kyc | ((of == "mode_of_holding") & held[0] & held[1]))
    )
    return steps.withColumn(name, same).select(*own, name)


def display_value(
    value: Column, field: str | Column, missing: Column, empty: Column, raw_kyc: Column | None = None
) -> Column:
    """Cell text: absent columns, blank cells, the KYC text of the file, amounts with separators."""
    of = F.lit(field) if isinstance(field, str) else field
    text = F.format_number(F.bround(value, 2), 2) if field is not of and field == "total_amount" else strip(value.cast("string"))
    if raw_kyc is not None:
        written = strip(raw_kyc)
        keep = (of == "kyc_status") & (written != "") & ~F.upper(raw_kyc).isin("NONE", "NAN", "N/A", "NA", "-")
        text = F.when(keep, written).otherwise(text)
    nothing = text.isNull() | (text == "") | F.lower(text).isin("nan", "none", "n/a", "na", "-")
    return (
        F.when(F.array_contains(missing, of), ABSENT).when(F.array_contains(empty, of), DASH)
        .when(nothing, DASH).otherwise(text)
    )


def _sheet_label(field: Column) -> Column:
    return lookup(field, {f: COMPARABLE[f].sheet_label for f in MATRIX_FIELDS})


def _cells(prefix: str = "", reference: str | None = None) -> Column:
    """Matrix fields of a row as an array of (field_no, name, reference, raw)."""
    return F.expr("array(" + ", ".join(
        f"named_struct('field_no', {i}, 'name', '{f}', 'reference', CAST({reference + f if reference else 'NULL'} AS STRING),"
        f" 'raw', CAST({prefix}{f} AS STRING))"
        for i, f in enumerate(MATRIX_FIELDS)
    ) + ")")


def _column_rank() -> Column:
    return F.coalesce(lookup(F.col("source"), COLUMN_RANK), F.lit("9")).cast("int")


def field_matrix_long(aligned: DataFrame, config: ReconConfig) -> DataFrame:
    """Side-by-side comparison in long form: one row per matched report row and matrix field.

    Columns: pan (of the client), field_no, field, column_label, column_rank, file_id, file_name,
    file_path, raw_row_index, crm_value, value, status (match, mismatch, verify or none).
    """
    helpers, differing = _differing_fields(config)
    listed = compare_profiles(config).by_source(
        lambda p: F.expr(f"array({', '.join(repr(f.strip().lower()) for f in p.compare)})").cast("array<string>")
    )
    flat = aligned.filter(F.col("match_route") != "UNMATCHED").withColumns(
        {**helpers, "_listed": listed, "_client": F.col("crm.pan"), "_crm_kyc": F.col("crm.kyc_status_raw")}
    ).drop("crm")
    kinds = F.map_from_entries(F.transform(differing, lambda d: F.struct(d.field_name, d.discrepancy_type)))
    cells = flat.withColumn("_types", kinds).select(
        F.col("_client").alias("pan"),
        F.concat(source_label(F.col("source")), code_suffix(F.col("folio_number"))).alias("column_label"),
        _column_rank().alias("column_rank"), "source", "file_id", "file_name", "file_path", "raw_row_index", "folio_number",
        "missing_fields", "empty_fields", "kyc_status_raw", "_crm_kyc", "_types", F.inline(_cells(reference="_crm_")),
    )
    none = F.array().cast("array<string>")
    name, reference, raw = F.col("name"), F.col("reference"), F.col("raw")
    shown = cells.withColumns({
        "value": display_value(raw, name, F.col("missing_fields"), F.col("empty_fields"), F.col("kyc_status_raw")),
        "crm_value": display_value(reference, name, none, none, F.col("_crm_kyc")),
        "_type": F.try_element_at("_types", name),
    })
    shown = values_match(shown, "raw", "reference", name, "_same")
    status = (
        F.when(F.col("value") == DASH,
               F.when(F.coalesce(reference, F.lit("")).isin("", DASH, "-"), "none").otherwise("verify"))
        .when(F.col("value") == ABSENT, "none")
        .when(F.col("_type").isNotNull(),
              F.when(F.upper(severity(config, F.col("_type"))).isin("CRITICAL", "HIGH", "MEDIUM"), "mismatch").otherwise("verify"))
        .when(F.col("_same"), "match").otherwise("mismatch")
    )
    return shown.select(
        "pan", "column_label", "column_rank", "source", "file_id", "file_name", "file_path", "raw_row_index", "folio_number",
        "field_no", _sheet_label(name).alias("field"), "crm_value", "value", status.alias("status"),
    )


def field_matrix(
    long: DataFrame, pan: str, duplicates: DataFrame | None = None, all_files: DataFrame | None = None,
    page: int = 0, per_page: int = 500,
) -> DataFrame:
    """Matrix of one client: a row per field, the CRM first and then a column per file and code.

    `duplicates` (rejected duplicate rows) come back as columns; files of `all_files` (source,
    file_name, and file_path where names repeat) without a row of the client get an empty column. A page has at most `per_page` of
    these columns, in the order of the whole matrix; the pages after the last have the CRM alone. The
    metadata of a column name its `file` and `raw_row_index`.
    """
    mine = long.filter(F.col("pan") == pan).withColumn("_file", file_key(long))
    mine = first_row(mine, ["field_no", "_file", F.coalesce("folio_number", F.lit(""))], ["raw_row_index"])
    place = ["column_rank", "file_name", "_file", "raw_row_index"]
    cells = mine.select("field_no", "field", "crm_value", "column_label", *place, "value")
    none = F.array().cast("array<string>")
    no_value = F.lit(None).cast("string")
    if duplicates is not None:
        extra = duplicates.filter(F.col("pan") == pan).select(
            F.concat(source_label(F.col("source")), code_suffix(F.col("folio_number"))).alias("column_label"),
            _column_rank().alias("column_rank"), "file_name", file_key(duplicates).alias("_file"), "raw_row_index",
            F.inline(_cells()),
        )
        cells = cells.unionByName(extra.select(
            "field_no", _sheet_label(F.col("name")).alias("field"), no_value.alias("crm_value"), "column_label",
            *place, display_value(F.col("raw"), F.col("name"), none, none).alias("value"),
        ))
    if all_files is not None:
        fields = F.expr("array(" + ", ".join(f"named_struct('field_no', {i}, 'name', '{f}')" for i, f in enumerate(MATRIX_FIELDS)) + ")")
        # a list of names alone cannot tell files of one name apart
        by = "_file" if "file_path" in all_files.columns else "file_name"
        listed = all_files.withColumn("_file", F.col("file_path") if by == "_file" else F.col("file_name"))
        empty = listed.join(cells.select(by).distinct(), by, "left_anti").select(
            source_label(F.col("source")).alias("column_label"), _column_rank().alias("column_rank"), "file_name", "_file",
            F.inline(fields),
        )
        cells = cells.unionByName(empty.select(
            "field_no", _sheet_label(F.col("name")).alias("field"), no_value.alias("crm_value"), "column_label",
            "column_rank", "file_name", "_file", F.lit(-1).cast("bigint").alias("raw_row_index"), F.lit(DASH).alias("value"),
        ))
    heads = cells.groupBy(*place).agg(F.min("column_label").alias("column_label"))
    # equal labels are numbered over the whole matrix
    heads = heads.withColumn("_nth", F.row_number().over(Window.partitionBy("column_label").orderBy(*place)))
    chosen = heads.orderBy(*place).offset(page * per_page).limit(per_page).collect()
    names = {
        (h["_file"], h.raw_row_index): h.column_label if h["_nth"] == 1 else f"{h.column_label} #{h['_nth']}" for h in chosen
    }

    def column(key: tuple) -> Column:
        test = (F.col("_file") == key[0]) & (F.col("raw_row_index") == key[1])
        return F.max(F.when(test, F.col("value"))).alias(names[key], metadata={"file": key[0], "raw_row_index": key[1]})

    return cells.groupBy("field_no", "field").agg(
        F.max("crm_value").alias("CRM (reference)"), *[column(k) for k in names]
    ).orderBy("field_no").drop("field_no")


def recommended_action(kind: Column) -> Column:
    return F.coalesce(lookup(kind, ACTION), F.lit(OTHER_ACTION))


def action_list(discrepancies: DataFrame, duplicates: DataFrame | None = None, first_name: str = "Investor") -> DataFrame:
    """Distinct findings with the value found, the value expected and what to do, worst first."""
    kind, dash = F.col("discrepancy_type"), F.lit(DASH)
    file = F.nullif(F.coalesce("file_name", F.lit("")), F.lit(""))
    fallback = F.when(kind == "MISSING_IN_CRM", "Report file").otherwise("crm_data.xlsx")
    is_copy = kind.isin("DUPLICATE_RECORD", "CONFLICTING_DUPLICATE", "EXACT_DUPLICATE")
    code = F.coalesce("crm_client_id", F.nullif("folio_number", F.lit("")), F.lit("N/A"))
    found = discrepancies.select(
        "severity",
        F.coalesce(discrepancy_column(), F.nullif(file, F.lit("N/A")), fallback).alias("source"),
        F.when(is_copy, F.concat(F.lit("Duplicate record, code '"), code, F.lit("'")))
        .otherwise(F.concat(F.lit(f"{first_name} — "), field_label(F.col("field_name")))).alias("field_record"),
        F.when(kind == "MISSING_IN_CRM", "Record exists in report but not in CRM")
        .when(kind == "MISSING_IN_REPORT", "Record exists in CRM but missing from report")
        .when(is_copy, F.coalesce(F.nullif("report_value", F.lit("")), "explanation"))
        .otherwise(F.coalesce("report_value", dash)).alias("found_value"),
        F.when(kind == "MISSING_IN_CRM", "Register investor in CRM")
        .when(kind == "MISSING_IN_REPORT", "Verify if folio exists or assets transferred")
        .when(is_copy, NO_DUPLICATES)
        .otherwise(F.coalesce("crm_value", dash)).alias("should_be"),
        recommended_action(kind).alias("recommended_action"),
        F.struct(*PLACE).alias("_place"),
    )
    keys = ["source", "field_record", "found_value", "should_be"]
    rows = found.groupBy(*keys).agg(F.min_by(F.struct("severity", "recommended_action"), "_place").alias("_first")).select(
        F.col("_first.severity").alias("severity"), *keys, F.col("_first.recommended_action").alias("recommended_action")
    )
    if duplicates is not None:
        copies = duplicates.select(
            source_label(F.col("source")).alias("source"),
            F.concat(F.lit("Duplicate record, code '"), F.coalesce(F.nullif("folio_number", F.lit("")), F.lit("N/A")),
                     F.lit("'")).alias("field_record"),
            F.concat(F.lit("Duplicate row "), F.col("raw_row_index").cast("string"), F.lit(" found in "), F.col("source"))
            .alias("found_value"),
            F.struct("file_id", "file_name", file_key(duplicates).alias("file"), "raw_row_index").alias("_place"),
        )
        rows = rows.unionByName(
            copies.groupBy("source", "field_record").agg(F.min_by("found_value", "_place").alias("found_value")).select(
                F.lit("HIGH").alias("severity"), "source", "field_record", "found_value",
                F.lit(NO_DUPLICATES).alias("should_be"), F.lit(_DUPLICATE).alias("recommended_action"),
            )
        )
    rank = F.coalesce(lookup(F.upper("severity"), SEVERITY_RANK), F.lit("5")).cast("int")
    return rows.withColumn("rank", rank).orderBy("rank", "field_record", "source", "found_value", "should_be")


def _masked_pan(c: Column) -> Column:
    return F.regexp_replace(c, r"\b([A-Z]{5})[0-9]{4}([A-Z])\b", "$1****$2")


def _masked_email(c: Column) -> Column:
    return F.regexp_replace(c, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@", "$1****@")


def _masked_mobile(c: Column) -> Column:
    return F.regexp_replace(c, r"\b[0-9]{6}([0-9]{4})\b", "******$1")


def _masked_number(c: Column) -> Column:
    """All but the last four letters or digits; shorter values whole."""
    return F.when(F.length(c) > 4, F.concat(F.repeat(F.lit("*"), F.length(c) - 4), F.right(c, F.lit(4)))).otherwise(
        F.repeat(F.lit("*"), F.length(c)))


def _masked_text(c: Column) -> Column:
    return _masked_mobile(_masked_email(_masked_pan(c)))


def _masked_cell(c: Column) -> Column:
    """A raw cell: identifiers as files write them, in any case and with blanks, dashes or a country code."""
    loose = F.regexp_replace(c, r"(?i)\b([A-Z]{5})[-/ ]?[0-9]{4}[-/ ]?([A-Z])\b", "$1****$2")
    digits = F.regexp_replace(c, r"\D", "")
    only_number = c.rlike(r"^[+0-9][-+0-9 ()./]*(?:\.0)?$") & (F.length(digits) >= 9)
    return F.when(only_number, _masked_number(digits)).otherwise(_masked_text(loose))


MASKS = {"pan": _masked_pan, "email": _masked_email, "mobile": _masked_mobile, "bank_account": _masked_number}
FREE_TEXT = ("crm_value", "report_value", "explanation", "message", "found_value", "should_be", "value", "issue", "reason")


def _masked(name: str, c: Column, dtype: T.DataType) -> Column | None:
    """The masked form of a column of any type, None if nothing in it can identify a client."""
    if isinstance(dtype, T.StringType):
        if name in MASKS:
            return MASKS[name](c)
        return _masked_text(c) if name in FREE_TEXT else None
    if isinstance(dtype, T.MapType) and name == "raw_data":
        return F.transform_values(c, lambda _, v: _masked_cell(v))
    if isinstance(dtype, T.StructType):
        fields = [(f.name, _masked(f.name, c[f.name], f.dataType)) for f in dtype.fields]
        if any(m is not None for _, m in fields):
            whole = F.struct(*[(c[n] if m is None else m).alias(n) for n, m in fields])
            return F.when(c.isNotNull(), whole)
    return None


def redact(df: DataFrame) -> DataFrame:
    """Mask PAN, e-mail, mobile and bank account: in their own columns, also nested ones, in compared
    values, in texts and in raw cells. The last step before a table leaves the run."""
    out = {f.name: _masked(f.name, F.col(f.name), f.dataType) for f in df.schema.fields}
    return df.withColumns({name: c for name, c in out.items() if c is not None})


def masked_export(name: str, df: DataFrame) -> Column:
    """A column of a flat export, masked by its name or else as text a client may be named in."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.StringType) or name in ("file_name", "file_path", "run_id"):
        return F.col(name)
    mask = MASKS.get(name, _masked_text)
    return mask(F.col(name)).alias(name)


def pan_key(pan: Column, key: str) -> Column:
    """Keyed hash of a PAN, to find a client's rows in masked tables."""
    return F.sha2(F.concat(F.lit(key), F.lit(":"), F.upper(F.trim(pan))), 256)


def search(discrepancies: DataFrame, text: str = "", severity: str = "ALL", source: str = "ALL") -> DataFrame:
    """Text in PAN or explanation, and optional filters, all without regard to case."""
    needle = F.lit(text.lower())
    hit = F.lower("pan").contains(needle) | F.coalesce(F.lower("explanation").contains(needle), F.lit(False))
    out = discrepancies.filter(hit)
    if severity.upper() != "ALL":
        out = out.filter(F.upper("severity") == severity.upper())
    if source.upper() != "ALL":
        out = out.filter(F.upper("source") == source.upper())
    return out


def pan_key_text(pan: str, key: str) -> str:
    """The keyed hash of one PAN, as `pan_key` gives it."""
    return hashlib.sha256(f"{key}:{pan.strip().upper()}".encode()).hexdigest()


def page_order(by: str = "severity", ascending: bool = False) -> list[Column]:
    """Columns by which results are sorted for paging. Ties keep file order."""
    keys = {
        "pan": F.col("pan"), "discrepancy_type": F.col("discrepancy_type"), "source": F.col("source"),
        "investor_name": F.coalesce("explanation", F.lit("")),
        "severity": -F.coalesce(lookup(F.col("severity"), SEVERITY_RANK), F.lit("5")).cast("int"),
    }
    return [keys[by].asc() if ascending else keys[by].desc(), *map(F.col, PLACE)]


def page(
    discrepancies: DataFrame, by: str = "severity", ascending: bool = False, number: int = 1, size: int = 10
) -> DataFrame:
    """A page of the sorted results. Spark sorts as far as the page: for late pages of a stored run see
    `plans.run.stored_page`."""
    return discrepancies.orderBy(*page_order(by, ascending)).offset((number - 1) * size).limit(size)


def client_extract(df: DataFrame, pans: Sequence[str], column: str | Column = "pan") -> DataFrame:
    """All rows of the given clients. More than a thousand are joined, as a table."""
    wanted = sorted({p.strip().upper() for p in pans if p.strip()})
    value = F.col(column) if isinstance(column, str) else column
    if len(wanted) <= 1_000:
        return df.filter(value.isin(wanted))
    listed = df.sparkSession.createDataFrame([(p,) for p in wanted], "_wanted string")
    keyed = df.withColumn("_wanted", value)
    return attach(keyed, listed, ["_wanted"], "left_semi", small=fits_broadcast(listed)).drop("_wanted")
