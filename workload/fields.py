"""Queries over single-field operators: normalisers, coercion, parsing, validation, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT_REPORT_PROFILE, Profiles, SourceProfile
from tallyframe.functions import normalize as N
from tallyframe.functions.status import normalize_status, read_status
from tallyframe.operators import metrics, parse
from tallyframe.operators.dedup import dedup_first, duplicates
from tallyframe.operators.normalize import normalize, split_normalized
from tallyframe.operators.validate import explode_failures, split_valid, with_failures
from tallyframe.schema import REPORT, conform
from tallyframe.sources import catalog
from workload.inputs import CRM_SQL, REP_SQL, crm_table, report_table, table
from workload.registry import query

BASE = f"WITH crm AS ({CRM_SQL}), rep AS ({REP_SQL})"


def derive(spark: SparkSession, folder: str, select: str, **views: DataFrame) -> DataFrame:
    """Run the same SELECT the oracle runs, over views named in braces."""
    given = views or {"crm": crm_table(spark, folder)}
    for name in given:
        select = select.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(select, **given)


# ---- normalisers -------------------------------------------------------------------------------

DIRTY_PAN = """
SELECT crm_client_id, CASE crm_order % 8
    WHEN 0 THEN lower(pan)
    WHEN 1 THEN concat(substring(pan, 1, 5), '-', substring(pan, 6, 4), '-', substring(pan, 10, 1))
    WHEN 2 THEN concat(' ', substring(pan, 1, 5), ' / ', substring(pan, 6, 5), ' ')
    WHEN 3 THEN concat(pan, 'X')
    WHEN 4 THEN substring(pan, 2, 9)
    WHEN 5 THEN ''
    ELSE pan END AS raw
FROM crm
"""


@query("normalize_pan", f"""
{BASE}, d AS ({DIRTY_PAN}), t AS (
  SELECT crm_client_id, raw, upper(replace(replace(replace(raw, ' ', ''), '-', ''), '/', '')) AS text FROM d)
SELECT crm_client_id, CASE WHEN regexp_full_match(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN text END AS pan,
  CASE WHEN raw = '' THEN 'PAN cannot be empty'
       WHEN NOT regexp_full_match(text, '[A-Z]{{5}}[0-9]{{4}}[A-Z]')
       THEN concat('Invalid PAN format: ''', raw, ''' (normalized: ''', text, ''')') END AS error
FROM t""")
def normalize_pan(spark, folder):
    df = derive(spark, folder, DIRTY_PAN)
    return df.select("crm_client_id", N.pan(F.col("raw")).alias("pan"), N.pan_error(F.col("raw")).alias("error"))


DIRTY_NAME = """
SELECT crm_client_id, investor_name, CASE crm_order % 8
    WHEN 0 THEN concat('Mr. ', lower(investor_name))
    WHEN 1 THEN concat(investor_name, ' / Jt. Holder')
    WHEN 2 THEN concat('M/s ', investor_name, ' HUF')
    WHEN 3 THEN concat('Late  Mrs ', replace(investor_name, ' ', ' - '))
    WHEN 4 THEN concat(investor_name, ', Joint Holder')
    WHEN 5 THEN 'Mr. Jt. Joint HUF'
    WHEN 6 THEN concat('  Dr.', investor_name, '  ')
    ELSE replace(investor_name, ' ', ' . ') END AS raw
FROM crm
"""


@query("normalize_name", f"""
{BASE}, d AS ({DIRTY_NAME})
SELECT crm_client_id, CASE WHEN raw = 'Mr. Jt. Joint HUF' THEN '' ELSE investor_name END AS investor_name FROM d""")
def normalize_name(spark, folder):
    # "HOLDER" is part of every name; only the joint-holder words around it are noise.
    df = derive(spark, folder, DIRTY_NAME)
    return df.select("crm_client_id", N.name(F.col("raw")).alias("investor_name"))


DIRTY_MOBILE = """
SELECT crm_client_id, CASE crm_order % 7
    WHEN 0 THEN '+91-' || mobile
    WHEN 1 THEN '0' || mobile
    WHEN 2 THEN substring(mobile, 1, 5) || ' ' || substring(mobile, 6, 5)
    WHEN 3 THEN '9999999999'
    WHEN 4 THEN substring(mobile, 1, 9)
    WHEN 5 THEN '1234567890'
    ELSE mobile END AS raw
FROM crm
"""


@query("normalize_mobile", f"""
{BASE}, d AS ({DIRTY_MOBILE}), t AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS a FROM d),
u AS (SELECT *, CASE WHEN length(a) > 10 AND starts_with(a, '91') THEN substring(a, 3)
                     WHEN length(a) > 10 AND starts_with(a, '0') THEN substring(a, 2) ELSE a END AS b FROM t),
v AS (SELECT *, CASE WHEN length(b) <> 10 THEN concat('Mobile number must normalize to exactly 10 digits: ''', raw, ''' (normalized: ''', b, ''')')
     WHEN b = repeat(substring(b, 1, 1), 10) THEN concat('Mobile number is an obvious repeating dummy: ''', raw, '''')
     WHEN b IN ('1234567890', '0123456789') THEN concat('Mobile number is a placeholder dummy: ''', raw, '''') END AS error FROM u)
SELECT crm_client_id, CASE WHEN error IS NULL THEN b END AS mobile, error FROM v""")
def normalize_mobile(spark, folder):
    df = derive(spark, folder, DIRTY_MOBILE)
    return df.select("crm_client_id", N.mobile(F.col("raw")).alias("mobile"), N.mobile_error(F.col("raw")).alias("error"))


DIRTY_EMAIL = """
SELECT crm_client_id, CASE crm_order % 6
    WHEN 0 THEN '  ' || upper(email) || ' '
    WHEN 1 THEN replace(email, '@', '')
    WHEN 2 THEN replace(email, '.com', '')
    WHEN 3 THEN replace(email, '@', '..@')
    ELSE email END AS raw
FROM crm
"""


@query("normalize_email", f"""
{BASE}, d AS ({DIRTY_EMAIL}), t AS (SELECT *, lower(trim(raw)) AS text FROM d),
u AS (SELECT *, regexp_full_match(text, '[a-z0-9]+@[a-z]+[.]com') AS ok FROM t)
SELECT crm_client_id, CASE WHEN ok THEN text END AS email,
  CASE WHEN NOT ok THEN concat('Invalid email format: ''', raw, '''') END AS error FROM u""")
def normalize_email(spark, folder):
    df = derive(spark, folder, DIRTY_EMAIL)
    return df.select("crm_client_id", N.email(F.col("raw")).alias("email"), N.email_error(F.col("raw")).alias("error"))


@query("normalize_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
  CASE WHEN o_orderkey % 11 = 10 THEN concat('Unable to parse date: ''', strftime(o_orderdate, '%Y.%m.%d'), '''') END AS error
FROM orders""")
def normalize_date(spark, folder):
    day, n = F.to_date("o_orderdate"), F.col("o_orderkey") % 11
    layouts = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "dd-MMMM-yyyy", "yyyy/MM/dd", "MMM dd, yyyy",
               "dd MMM yyyy"]
    raw = F
    for i, layout in enumerate(layouts):
        raw = raw.when(n == i, F.date_format(day, layout))
    raw = (
        raw.when(n == 8, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(n == 9, F.upper(F.date_format(day, "d-MMM-yyyy"))).otherwise(F.date_format(day, "yyyy.MM.dd"))
    )
    df = table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    return df.select("o_orderkey", N.date(F.col("raw")).alias("order_date"), N.date_error(F.col("raw")).alias("error"))


@query("normalize_amount", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN 0
    ELSE CAST(o_totalprice AS DECIMAL(18,2)) END::DECIMAL(18,2) AS amount,
  CASE WHEN o_orderkey % 5 = 4 THEN concat('Invalid amount format: ''', 'Rs ', o_orderkey::VARCHAR, '''') END AS error
FROM orders""")
def normalize_amount(spark, folder):
    n, price = F.col("o_orderkey") % 5, F.col("o_totalprice").cast("decimal(18,2)")
    raw = (
        F.when(n == 0, F.format_number(price, 2)).when(n == 1, F.concat(F.lit(" "), price.cast("string"), F.lit(" ")))
        .when(n == 2, price.cast("string")).when(n == 3, F.lit(" ")).otherwise(F.concat(F.lit("Rs "), "o_orderkey"))
    )
    df = table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    return df.select("o_orderkey", N.amount(F.col("raw")).cast("decimal(18,2)").alias("amount"),
                     N.amount_error(F.col("raw")).alias("error"))


STATUS_TEXT = """
SELECT crm_client_id,
  CASE crm_order % 9 WHEN 0 THEN 'k' WHEN 1 THEN 'KRA Compliant' WHEN 2 THEN 'in progress' WHEN 3 THEN 'rejected'
    WHEN 4 THEN 'PAN EXEMPT' WHEN 5 THEN 'whatever' WHEN 6 THEN ' Verified ' WHEN 7 THEN 'under process' ELSE NULL END AS kyc,
  CASE crm_order % 7 WHEN 0 THEN 'c' WHEN 1 THEN 'nc' WHEN 2 THEN 'Non-Compliant' WHEN 3 THEN 'submitted'
    WHEN 4 THEN 'PENDING' WHEN 5 THEN 'fatca compliant' ELSE '?' END AS fatca,
  CASE crm_order % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'closed' WHEN 2 THEN 'Frozen' WHEN 3 THEN 'active status'
    WHEN 4 THEN 'enabled' ELSE 'SUSPENDED' END AS status
FROM crm
"""


@query("map_status", f"""
{BASE}, d AS ({STATUS_TEXT})
SELECT crm_client_id,
  CASE WHEN kyc IN ('k', 'KRA Compliant', ' Verified ') THEN 'VERIFIED' WHEN kyc = 'in progress' THEN 'PENDING'
       WHEN kyc = 'rejected' THEN 'FAILED' WHEN kyc = 'PAN EXEMPT' THEN 'EXEMPT' ELSE 'UNKNOWN' END AS kyc_read,
  CASE WHEN fatca IN ('c', 'fatca compliant') THEN 'COMPLIANT' WHEN fatca = 'nc' THEN 'NON_COMPLIANT'
       WHEN fatca IN ('submitted', 'PENDING') THEN 'PENDING' ELSE 'UNKNOWN' END AS fatca_read,
  CASE WHEN status IN ('a', 'enabled') THEN 'ACTIVE' WHEN status = 'closed' THEN 'INACTIVE'
       WHEN status IN ('Frozen', 'SUSPENDED') THEN 'SUSPENDED' ELSE 'UNKNOWN' END AS status_read,
  CASE WHEN kyc = ' Verified ' THEN 'VERIFIED' WHEN kyc IN ('in progress', 'under process') THEN 'PENDING'
       WHEN kyc = 'rejected' THEN 'FAILED' WHEN kyc = 'PAN EXEMPT' THEN 'EXEMPT' ELSE 'UNKNOWN' END AS kyc_normalized,
  CASE WHEN fatca = 'fatca compliant' THEN 'COMPLIANT' WHEN fatca = 'Non-Compliant' THEN 'NON_COMPLIANT'
       WHEN fatca = 'PENDING' THEN 'PENDING' ELSE 'UNKNOWN' END AS fatca_normalized,
  CASE WHEN status = 'active status' THEN 'ACTIVE' WHEN status = 'closed' THEN 'INACTIVE'
       WHEN status IN ('Frozen', 'SUSPENDED') THEN 'SUSPENDED' ELSE 'UNKNOWN' END AS status_normalized
FROM d""")
def map_status(spark, folder):
    kinds = {"kyc": "kyc_status", "fatca": "fatca_status", "status": "investor_status"}
    return derive(spark, folder, STATUS_TEXT).select(
        "crm_client_id",
        *[read_status(F.col(c), f).alias(f"{c}_read") for c, f in kinds.items()],
        *[normalize_status(F.col(c), f).alias(f"{c}_normalized") for c, f in kinds.items()],
    )


# ---- parse stage -------------------------------------------------------------------------------

CELLS = """
SELECT crm_client_id, crm_order, CASE crm_order % 8 WHEN 0 THEN '' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'None'
    WHEN 3 THEN 'N/A' WHEN 4 THEN ' - ' WHEN 5 THEN concat(crm_client_id, '.0')
    WHEN 6 THEN concat('  ', pan, ' ') ELSE '007' END AS raw
FROM crm
"""


@query("coerce_nulls", f"""
{BASE}, d AS ({CELLS})
SELECT crm_client_id, CASE WHEN crm_order % 8 < 5 THEN NULL WHEN crm_order % 8 = 5 THEN crm_client_id ELSE trim(raw) END AS cell
FROM d""")
def coerce_nulls(spark, folder):
    return derive(spark, folder, CELLS).select("crm_client_id", parse.clean_text(F.col("raw")).alias("cell"))


@query("surrogate_id", f"""
{BASE}
SELECT crm_order, CASE WHEN crm_order % 3 = 0 THEN concat('AUTO_GEN_', substring(md5(CAST(crm_order AS VARCHAR)), 1, 8))
  ELSE crm_client_id END AS crm_client_id FROM crm""")
def surrogate_id(spark, folder):
    given = F.when(F.col("crm_order") % 3 != 0, F.col("crm_client_id"))
    return crm_table(spark, folder).select(
        "crm_order", F.coalesce(given, parse.surrogate_id(F.col("crm_order"))).alias("crm_client_id")
    )


TAX = """
SELECT crm_client_id, CASE crm_order % 5 WHEN 0 THEN 'On Behalf of Minor' WHEN 1 THEN 'minor' WHEN 2 THEN 'Individual'
    WHEN 3 THEN 'HUF' ELSE NULL END AS tax_status FROM crm
"""


@query("minor_flag", f"""
{BASE}, d AS ({TAX})
SELECT crm_client_id, coalesce(upper(tax_status) LIKE '%MINOR%', FALSE) AS is_minor_account FROM d""")
def minor_flag(spark, folder):
    return derive(spark, folder, TAX).select("crm_client_id", parse.is_minor(F.col("tax_status")).alias("is_minor_account"))


@query("presence_lists", f"""
{BASE}
SELECT source, raw_row_index,
  concat_ws(',', CASE WHEN trim(coalesce(mobile, '')) = '' THEN 'mobile' END,
                 CASE WHEN email_cell_blank OR email IS NULL THEN 'email' END) AS empty_fields,
  'kyc_status,fatca_status,investor_status,last_transaction_date,total_amount' AS missing_fields
FROM rep""")
def presence_lists(spark, folder):
    email = F.when(F.col("email_cell_blank"), " ").otherwise(F.col("email"))
    cells = {"pan": F.col("pan"), "investor_name": F.col("investor_name"), "mobile": F.col("mobile"), "email": email}
    return report_table(spark, folder).select(
        "source", "raw_row_index", F.array_join(parse.empty_fields(cells), ",").alias("empty_fields"),
        F.array_join(parse.missing_fields(cells), ",").alias("missing_fields"),
    )


SPLIT = """
SELECT crm_client_id, split_part(investor_name, ' ', 1) AS first_name,
  CASE WHEN crm_order % 3 = 0 THEN NULL ELSE ' HOLDER ' END AS middle_name, split_part(investor_name, ' ', 3) AS last_name,
  pan, concat(crm_client_id, ' Main Road') AS a1, CASE WHEN crm_order % 2 = 0 THEN ' ' ELSE 'Block B' END AS a2,
  CASE WHEN crm_order % 4 = 0 THEN NULL ELSE 'Pune' END AS city,
  CASE WHEN crm_order % 5 = 0 THEN NULL ELSE 'Spouse' END AS relation, CASE WHEN crm_order % 6 = 0 THEN NULL ELSE '50' END AS share
FROM crm
"""


@query("split_columns", f"""
{BASE}, d AS ({SPLIT})
SELECT crm_client_id, CASE WHEN middle_name IS NULL THEN concat(first_name, ' ', last_name)
    ELSE concat(first_name, ' HOLDER ', last_name) END AS investor_name, pan,
  concat(a1, CASE WHEN trim(a2) = '' THEN '' ELSE concat(', ', a2) END, coalesce(', ' || city, '')) AS registered_address,
  concat_ws(' / ', relation, share || '%') AS nominee_relation
FROM d""")
def split_columns(spark, folder):
    headers = {
        "Primary Holder First Name": "first_name", "Primary Holder Middle Name": "middle_name",
        "Primary Holder Last Name": "last_name", "Primary Holder PAN": "pan", "Address 1": "a1", "Address 2": "a2",
        "City": "city", "Nominee 1 Relationship": "relation", "Nominee 1 Applicable(%)": "share",
    }
    added = parse.split_columns({h: F.col(c) for h, c in headers.items()})
    return derive(spark, folder, SPLIT).select(
        "crm_client_id", added["Investor Name"].alias("investor_name"), added["PAN"].alias("pan"),
        added["Registered Address"].alias("registered_address"), added["Nominee Relation"].alias("nominee_relation"),
    )


RAW = """
SELECT CASE WHEN crm_order % 31 = 0 THEN NULL ELSE pan END AS pan_no,
  CASE WHEN crm_order % 37 = 0 THEN 'n/a' ELSE investor_name END AS client_name, concat('F', crm_client_id) AS folio,
  CASE WHEN crm_order % 41 = 0 THEN 'abc' WHEN crm_order % 43 = 0 THEN NULL ELSE CAST(total_amount AS STRING) END AS amount,
  mobile, CASE WHEN crm_order % 47 = 0 THEN 'bad' ELSE email END AS email,
  CASE WHEN crm_order % 5 = 0 THEN 'in progress' ELSE 'K' END AS kyc, crm_order
FROM crm
"""

PARSED_ORACLE = f"""
{BASE}, d AS ({RAW}), t AS (
SELECT *, CASE WHEN pan_no IS NULL OR client_name = 'n/a' THEN concat('Missing required fields: ',
      concat_ws(', ', CASE WHEN pan_no IS NULL THEN 'PAN' END, CASE WHEN client_name = 'n/a' THEN 'Investor Name' END))
    ELSE concat_ws('; ', CASE WHEN email = 'bad' THEN 'email: value is not a valid email address' END,
      CASE WHEN amount IS NULL THEN 'total_amount: Decimal input should be an integer, float, string or Decimal object'
           WHEN amount = 'abc' THEN 'total_amount: Input should be a valid decimal' END) END AS reason FROM d)
"""


def parsed_rows(spark, folder):
    raw = derive(spark, folder, RAW).select(
        F.col("pan_no").alias("PAN_NO"), F.col("client_name").alias("Client Name"), F.col("folio").alias("Folio"),
        F.col("amount").alias("Amount"), F.col("mobile").alias("Mobile"), F.col("email").alias("Email"),
        F.col("kyc").alias("KYC"), F.col("crm_order").alias("_row"), F.lit("kfintech.csv").alias("_file_name"),
        F.lit("in").alias("_file_id"),
    )
    return parse.parse_table(raw, "KFINTECH")


@query("parse_rows", PARSED_ORACLE + """
SELECT crm_order + 2 AS raw_row_index, pan_no AS pan, client_name AS investor_name, folio AS folio_number,
  CAST(amount AS DECIMAL(18,2)) AS total_amount, mobile, email,
  CASE WHEN kyc = 'K' THEN 'VERIFIED' ELSE 'PENDING' END AS kyc_status, kyc AS kyc_status_raw,
  'fatca_status,investor_status,last_transaction_date' AS missing_fields
FROM t WHERE reason = ''""")
def parse_rows(spark, folder):
    accepted, _ = parse.split_parsed(parsed_rows(spark, folder))
    return accepted.select(
        "raw_row_index", "pan", "investor_name", "folio_number", F.col("total_amount").cast("decimal(18,2)").alias("total_amount"),
        "mobile", "email", "kyc_status", "kyc_status_raw", F.array_join("missing_fields", ",").alias("missing_fields"),
    )


@query("mandatory_gate", PARSED_ORACLE + "SELECT crm_order + 2 AS row_number, reason FROM t WHERE reason <> ''")
def mandatory_gate(spark, folder):
    return parse.split_parsed(parsed_rows(spark, folder))[1].select("row_number", "reason")


@query("parse_counts", PARSED_ORACLE + """
SELECT 'kfintech.csv' AS file_name, count(*) AS total_rows, count(*) FILTER (WHERE reason = '') AS parsed_rows,
  count(*) FILTER (WHERE reason <> '') AS failed_rows FROM t""")
def parse_counts(spark, folder):
    return metrics.parse_counts(parsed_rows(spark, folder), ("file_name",))


FILES = """
SELECT c_custkey AS file_no,
  CASE c_custkey % 9 WHEN 0 THEN concat('Insurance_', c_custkey, '.csv') WHEN 1 THEN concat('MFSD211_', c_custkey, '.csv')
    WHEN 2 THEN concat('x', c_custkey, '.pdf') WHEN 3 THEN concat('bse_', c_custkey, '.xlsx') WHEN 8 THEN concat('x', c_custkey, '.doc')
    ELSE concat('f', c_custkey, '.csv') END AS file_name,
  CASE c_custkey % 5 WHEN 0 THEN 'Folio' WHEN 1 THEN 'NSE_PAN' WHEN 2 THEN 'Karvy Ref' WHEN 3 THEN 'Policy No' ELSE 'Remark' END AS header
FROM customer
"""


@query("detect_source", f"""
WITH d AS ({FILES}), t AS (SELECT *, lower(file_name) AS f, lower(concat('PAN ', header)) AS h FROM d),
u AS (SELECT *, CASE WHEN f LIKE '%.pdf' THEN 'PDF_CAS' WHEN f LIKE '%.doc' THEN NULL
  WHEN f LIKE '%insurance%' OR h LIKE '%policy%' THEN 'INSURANCE' WHEN f LIKE '%mfsd211%' OR h LIKE '%karvy%' THEN 'KFINTECH'
  WHEN f LIKE '%bse%' OR h LIKE '%bse%' THEN 'BSE' WHEN f LIKE '%nse%' OR h LIKE '%nse%' THEN 'NSE'
  WHEN h LIKE '%folio%' THEN 'CAMS' END AS source FROM t)
SELECT file_no, file_name, source, CASE WHEN source IS NULL THEN
  CASE WHEN f LIKE '%.doc' THEN 'Unsupported extension for auto-detection: .doc'
  ELSE concat('Could not auto-detect report source for file: ', file_name) END END AS failure FROM u""")
def detect_source(spark, folder):
    df = derive(spark, folder, FILES, customer=table(spark, folder, "customer"))
    headers = F.array(F.lit("PAN"), F.col("header"))
    source = catalog.detect_source(F.col("file_name"), headers, F.array().cast("array<string>"))
    return df.select(
        "file_no", "file_name", source.alias("source"),
        F.when(source.isNull(), catalog.detection_failure(F.col("file_name"))).alias("failure"),
    )


# ---- validation and duplicates ------------------------------------------------------------------

DIRTY_REP = """
SELECT source, file_name, file_id, raw_row_index, folio_number,
  CASE WHEN raw_row_index % 43 = 0 THEN concat('B', pan) ELSE pan END AS pan,
  CASE WHEN raw_row_index % 47 = 0 THEN ' ' ELSE investor_name END AS investor_name,
  CASE WHEN raw_row_index % 41 = 0 THEN '12345' WHEN raw_row_index % 53 = 0 THEN '9999999999' ELSE mobile END AS mobile,
  CASE WHEN raw_row_index % 59 = 0 THEN 'not-an-email' ELSE email END AS email,
  kyc_status, fatca_status, investor_status, total_amount
FROM rep
"""
STRICT = SourceProfile(
    available_fields=("pan", "investor_name", "mobile", "email", "total_amount", "kyc_status", "fatca_status", "investor_status"),
    required_fields=("pan", "investor_name", "mobile"),
    validations=("pan_format", "mobile_format", "email_format", "kyc_status", "fatca_status_format", "investor_status"),
)
_RULES = """
  CASE WHEN NOT regexp_full_match(pan, '[A-Z]{5}[0-9]{4}[A-Z]') THEN 'INVALID_PAN_FORMAT' END,
  CASE WHEN mobile IN ('12345', '9999999999') THEN 'INVALID_MOBILE_FORMAT' END,
  CASE WHEN email = 'not-an-email' THEN 'INVALID_EMAIL_FORMAT' END,
  CASE WHEN kyc_status NOT IN ('VERIFIED', 'EXEMPT', 'PENDING') THEN 'INVALID_KYC_STATUS' END,
  CASE WHEN fatca_status NOT IN ('COMPLIANT', 'NON_COMPLIANT', 'PENDING') THEN 'INVALID_FATCA_STATUS' END,
  CASE WHEN investor_status NOT IN ('ACTIVE', 'INACTIVE', 'SUSPENDED') THEN 'INVALID_INVESTOR_STATUS' END
"""
_REQUIRED = """
  CASE WHEN trim(investor_name) = '' THEN 'investor_name' END,
  CASE WHEN mobile IS NULL THEN 'mobile' END
"""


def _dirty(spark, folder):
    df = derive(spark, folder, DIRTY_REP, rep=report_table(spark, folder))
    return conform(df, REPORT)


def _messages(df, check, *columns):
    failed = with_failures(df, Profiles({}, STRICT), checks=(check,))
    return explode_failures(split_valid(failed)[1]).select("source", "raw_row_index", *columns)


@query("validate_rules", f"""
{BASE}, d AS ({DIRTY_REP})
SELECT source, raw_row_index, unnest(list_filter([{_RULES}], lambda x: x IS NOT NULL)) AS failure_type FROM d""")
def validate_rules(spark, folder):
    return _messages(_dirty(spark, folder), "format", "failure_type")


@query("required_fields", f"""
{BASE}, d AS ({DIRTY_REP}), t AS (
SELECT source, raw_row_index, unnest(list_filter([{_REQUIRED}], lambda x: x IS NOT NULL)) AS field_name FROM d)
SELECT *, concat('Required field ''', field_name, ''' is missing or empty.') AS message FROM t""")
def required_fields(spark, folder):
    return _messages(_dirty(spark, folder), "required", "field_name", "message")


@query("unexpected_fields", f"""
{BASE}, d AS ({DIRTY_REP}), t AS (
SELECT source, raw_row_index, unnest(list_filter([CASE WHEN kyc_status <> 'UNKNOWN' THEN 'kyc_status' END,
  CASE WHEN fatca_status <> 'UNKNOWN' THEN 'fatca_status' END, 'investor_status'], lambda x: x IS NOT NULL)) AS field_name FROM d)
SELECT * FROM t""")
def unexpected_fields(spark, folder):
    failed = with_failures(_dirty(spark, folder), Profiles({}, DEFAULT_REPORT_PROFILE), checks=("unexpected",))
    return explode_failures(split_valid(failed)[1]).select("source", "raw_row_index", "field_name")


@query("validate_split", f"""
{BASE}, d AS ({DIRTY_REP}), t AS (SELECT source, raw_row_index,
  len(list_filter([{_RULES}], lambda x: x IS NOT NULL)) + len(list_filter([{_REQUIRED}], lambda x: x IS NOT NULL)) AS failures FROM d)
SELECT source, count(*) FILTER (WHERE failures = 0) AS valid_rows, count(*) FILTER (WHERE failures > 0) AS invalid_rows,
  CAST(sum(failures) AS BIGINT) AS failure_count FROM t GROUP BY source""")
def validate_split(spark, folder):
    checked = with_failures(_dirty(spark, folder), Profiles({}, STRICT))
    n = F.size("failures")
    return checked.groupBy("source").agg(
        F.count(F.when(n == 0, 1)).alias("valid_rows"), F.count(F.when(n > 0, 1)).alias("invalid_rows"),
        F.sum(n).alias("failure_count"),
    )


@query("normalize_split", f"""
{BASE}, d AS ({DIRTY_REP})
SELECT source, raw_row_index, CASE
  WHEN NOT regexp_full_match(pan, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN concat('Invalid PAN format: ''', pan, ''' (normalized: ''', pan, ''')')
  WHEN mobile = '12345' THEN 'Mobile number must normalize to exactly 10 digits: ''12345'' (normalized: ''12345'')'
  WHEN mobile = '9999999999' THEN 'Mobile number is an obvious repeating dummy: ''9999999999'''
  ELSE 'Invalid email format: ''not-an-email''' END AS message
FROM d WHERE NOT regexp_full_match(pan, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') OR mobile IN ('12345', '9999999999') OR email = 'not-an-email'""")
def normalize_split(spark, folder):
    refused = split_normalized(normalize(_dirty(spark, folder)))[1]
    return refused.select("source", "raw_row_index", F.col("norm_error").alias("message"))


COPIES = """
SELECT source, file_name, file_id, raw_row_index, folio_number, pan, investor_name, mobile, email, kyc_status, fatca_status,
  investor_status, total_amount FROM rep
UNION ALL
SELECT source, file_name, file_id, raw_row_index + 1000000, concat(folio_number, ' '), pan, investor_name, mobile, email, kyc_status,
  fatca_status, CASE WHEN (raw_row_index - 2) % 51 = 0 THEN 'SUSPENDED' ELSE investor_status END,
  CAST(total_amount + CASE WHEN (raw_row_index - 2) % 34 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) FROM rep
WHERE (raw_row_index - 2) % 17 = 0
"""


def _copies(spark, folder):
    return conform(derive(spark, folder, COPIES, rep=report_table(spark, folder)), REPORT)


_RANKED = f"""
{BASE}, d AS ({COPIES}), t AS (SELECT *, trim(folio_number) AS part,
  row_number() OVER w AS n, first_value(total_amount) OVER w AS first_amount, first_value(investor_status) OVER w AS first_status
  FROM d WINDOW w AS (PARTITION BY file_name, pan, trim(folio_number) ORDER BY raw_row_index))
"""


@query("dedup_first", _RANKED + "SELECT source, raw_row_index, pan, folio_number, total_amount FROM t WHERE n = 1")
def dedup_survivors(spark, folder):
    return dedup_first(_copies(spark, folder)).select(
        "source", "raw_row_index", "pan", "folio_number", F.col("total_amount").cast("decimal(18,2)").alias("total_amount")
    )


@query("dedup_classify", _RANKED + """
, u AS (SELECT *, concat_ws(', ', CASE WHEN investor_status <> first_status THEN 'investor_status' END,
  CASE WHEN total_amount <> first_amount THEN 'total_amount' END) AS conflicts FROM t WHERE n > 1)
SELECT source, raw_row_index, CASE WHEN conflicts = '' THEN 'EXACT_DUPLICATE' ELSE 'CONFLICTING_DUPLICATE' END AS failure_type,
  conflicts, CASE WHEN conflicts = '' THEN concat('Exact duplicate record found for PAN ''', pan, '''.')
  ELSE concat('Conflicting duplicate record found for PAN ''', pan, '''. Conflict in fields: ', conflicts, '.') END AS message FROM u""")
def dedup_classify(spark, folder):
    return duplicates(_copies(spark, folder)).select(
        "source", "raw_row_index", "failure_type", F.array_join("conflicts", ", ").alias("conflicts"), "message"
    )


@query("validation_counts", f"""
{BASE}, d AS ({DIRTY_REP}), a AS (SELECT * FROM d UNION ALL SELECT source, file_name, file_id, raw_row_index + 1000000, folio_number,
  pan, investor_name, mobile, email, kyc_status, fatca_status, investor_status, total_amount FROM d WHERE raw_row_index % 17 = 0),
f AS (SELECT *, len(list_filter([{_RULES}], lambda x: x IS NOT NULL)) + len(list_filter([{_REQUIRED}], lambda x: x IS NOT NULL)) AS failures FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY file_name, pan, folio_number, failures = 0 ORDER BY raw_row_index) AS n FROM f)
SELECT file_name, count(*) AS total_records, count(*) FILTER (WHERE failures = 0 AND n = 1) AS valid_records,
  count(*) FILTER (WHERE failures > 0 OR n > 1) AS invalid_records,
  count(*) FILTER (WHERE failures = 0 AND n > 1) AS duplicate_records FROM k GROUP BY file_name""")
def validation_counts(spark, folder):
    dirty = _dirty(spark, folder)
    again = dirty.filter("raw_row_index % 17 = 0").withColumn("raw_row_index", F.col("raw_row_index") + 1_000_000)
    checked = with_failures(dirty.unionByName(again), Profiles({}, STRICT))
    return metrics.validation_counts(checked, dedup_first(split_valid(checked)[0]))
