"""Queries over the file layer: tables written as files and read back, files of one name, stored runs."""

from __future__ import annotations

import uuid
from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.config import Matching
from tallyframe.operators import metrics, views
from tallyframe.operators.dedup import dedup_first
from tallyframe.operators.parse import parse_table
from tallyframe.plans.reconcile import reconcile
from tallyframe.plans.run import load_reports, prepare, stored_breakdown, stored_client, stored_order, stored_page, stored_search
from tallyframe.schema import REPORT, conform
from tallyframe.sources import files, sinks, workbook
from tallyframe.storage import scratch_folder
from workload.books import write_books, write_files
from workload.fields import BASE, COPIES, PARSED_ORACLE, derive, parsed_rows
from workload.inputs import crm_table, report_table
from workload.recon import CELLS_SQL, CONFIG, FLOW, flow, merged_matrix, sides
from workload.registry import query

PARTS = 64

# Every eleventh name runs over a line end and holds a quote.
CELLS = """
SELECT pmod(raw_row_index, 64) AS part, raw_row_index, pan,
  CASE WHEN raw_row_index % 11 = 0 THEN concat(investor_name, ' "K",', chr(10), 'Jr') ELSE investor_name END AS investor_name,
  coalesce(email, '') AS email
FROM rep
"""


@query("scan_csv", f"""{BASE}, cells AS ({CELLS.replace('pmod(raw_row_index, 64)', 'raw_row_index % 64')})
SELECT CAST(part AS VARCHAR) AS part, row_number() OVER (PARTITION BY part ORDER BY raw_row_index) - 1 AS row_no, pan, investor_name,
  nullif(email, '') AS email FROM cells""")
def scan_csv(spark, folder):
    """One file per part, its rows in the order of their index."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    cells = derive(spark, folder, CELLS, rep=report_table(spark, folder))
    cells.repartition(PARTS, "part").sortWithinPartitions("part", "raw_row_index").drop("raw_row_index").write.partitionBy(
        "part").option("header", True).option("escape", '"').csv(path)
    rows = files.scan_csv(spark, [path], ["pan", "investor_name", "email"])
    return rows.select(
        F.regexp_extract("_file_path", r"part=(\d+)", 1).alias("part"), F.col("_row").alias("row_no"),
        F.col("_c0").alias("pan"), F.col("_c1").alias("investor_name"), F.nullif("_c2", F.lit("")).alias("email"))


MONTHS = f"""
SELECT concat(m.month, '/', d.file_id, '/', d.file_name) AS file_path, d.* FROM ({COPIES}) d
CROSS JOIN (SELECT 'jan' AS month UNION ALL SELECT 'feb') m
"""


@query("dedup_same_file_name", f"""{BASE}, d AS ({MONTHS}), t AS (SELECT *, row_number() OVER (
  PARTITION BY file_path, pan, trim(folio_number) ORDER BY raw_row_index) AS n FROM d)
SELECT file_path, raw_row_index, pan FROM t WHERE n = 1""")
def dedup_same_file_name(spark, folder):
    """Two folders hold files of the same parent folder and name; each is de-duplicated by itself."""
    rows = conform(derive(spark, folder, MONTHS, rep=report_table(spark, folder)), REPORT)
    return dedup_first(rows).select("file_path", "raw_row_index", "pan")


# Two folders hold report files of one name; those of one month have other e-mail addresses.
TWICE = """
SELECT concat(m.month, '/', r.file_id, '/', r.file_name) AS file_path, m.month, r.source, r.file_name, r.file_id, r.raw_row_index,
  r.folio_number, r.pan, r.investor_name, r.mobile, CASE WHEN m.month = 'feb' THEN concat('feb.', r.email) ELSE r.email END AS email,
  r.kyc_status, r.fatca_status, r.investor_status, r.total_amount
FROM rep r CROSS JOIN (SELECT 'jan' AS month UNION ALL SELECT 'feb') m
"""
TWICE_PAIRS = f"""{BASE}, d AS ({TWICE}), pairs AS (
  SELECT d.*, c.pan AS c_pan, c.investor_name AS c_name, c.mobile AS c_mobile, c.email AS c_email, c.kyc_status AS c_kyc,
    c.fatca_status AS c_fatca, c.investor_status AS c_status, c.total_amount AS c_amount FROM d JOIN crm c USING (pan))"""


def twice(spark, folder):
    """Exact matches of the files of both folders, compared."""
    crm, _ = sides(spark, folder)
    reports = conform(derive(spark, folder, TWICE, rep=report_table(spark, folder)), REPORT)
    return reconcile(crm, reports, replace(CONFIG, matching=Matching()))


@query("clean_sources_same_name", TWICE_PAIRS + """
SELECT c_pan AS pan, concat(CASE WHEN source = 'NSE' THEN 'NSE' ELSE 'CAMS/KFintech' END, ' (code ', folio_number, ')') AS source_label,
  min(raw_row_index) AS raw_row_index
FROM pairs WHERE c_name = investor_name AND c_mobile IS NOT DISTINCT FROM mobile AND (source = 'KFINTECH' OR c_email IS NOT DISTINCT FROM email)
  AND c_kyc = kyc_status AND c_fatca = fatca_status AND c_status = investor_status AND abs(c_amount - total_amount) <= 0.05 GROUP BY 1, 2""")
def clean_sources_same_name(spark, folder):
    """A difference in one month's file leaves the file of the same name in the other month clean."""
    r = twice(spark, folder)
    return metrics.clean_sources(r.matched, r.discrepancies).select("pan", "source_label", "raw_row_index")


@query("matrix_same_name", TWICE_PAIRS + f""", lab AS (
  SELECT *, month AS column_label FROM pairs WHERE c_pan = (SELECT min(c_pan) FROM pairs WHERE email IS NOT NULL)),
cells AS ({CELLS_SQL})
SELECT field, max(crm_value) AS crm_value, max(value) FILTER (column_label = 'feb') AS feb, max(value) FILTER (column_label = 'jan') AS jan
FROM cells GROUP BY field""")
def matrix_same_name(spark, folder):
    """Two files of one name are two columns of a client's matrix."""
    aligned = twice(spark, folder).aligned
    pan = aligned.filter("match_route != 'UNMATCHED' AND email IS NOT NULL").agg(F.min("crm.pan")).first()[0]
    return merged_matrix(views.field_matrix_long(aligned, CONFIG), pan, {"feb": "feb/", "jan": "jan/"})


@query("fuzzy_threshold_zero", f"""{FLOW}, b0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_row_index
  ORDER BY score DESC, kind, crm_order) AS n FROM scored) WHERE n = 1)
SELECT e.source, e.raw_row_index, b.crm_order AS master FROM exact e LEFT JOIN b0 b USING (raw_row_index) WHERE e.hit IS NULL""")
def fuzzy_threshold_zero(spark, folder):
    """Any name counts as long as a contact agrees."""
    matching = Matching(enable_fuzzy_matching=True, fuzzy_threshold=0.0, fuzzy_secondary_keys=("mobile", "email"))
    aligned = flow(spark, folder, replace(CONFIG, matching=matching)).aligned.filter("match_route != 'EXACT_PAN'")
    return aligned.select("source", "raw_row_index", F.col("crm.crm_order").alias("master"))


@query("stored_client_extract", f"""{FLOW}, w AS (SELECT pan FROM (SELECT DISTINCT pan FROM disc) ORDER BY pan LIMIT 3)
SELECT d.discrepancy_type, concat(substring(d.pan, 1, 5), '****', substring(d.pan, 10, 1)) AS pan, d.severity, d.raw_row_index
FROM disc d JOIN w USING (pan)""")
def stored_client_extract(spark, folder):
    """Three clients' rows from a masked table of a stored run, found by the keyed hash of their PAN."""
    path, run_id = f"{scratch_folder(spark)}/{uuid.uuid4().hex}", "r"
    found = flow(spark, folder).discrepancies.withColumn("pan_key", views.pan_key(F.col("pan"), "key"))
    pans = [r.pan for r in found.select("pan").distinct().orderBy("pan").limit(3).collect()]
    sinks.write_tables({"discrepancies": views.redact(found)}, path, run_id)
    rows = stored_client(spark, path, run_id, pans, key="key")
    return rows.select("discrepancy_type", "pan", "severity", "raw_row_index")


def stored_run(spark, folder):
    """Folder of a stored run's discrepancies."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_tables({"discrepancies": flow(spark, folder).discrepancies}, path, "r")
    return path


@query("deep_page", f"""{FLOW}, ranked AS (SELECT discrepancy_type, pan, severity, field_name, raw_row_index, count(*) OVER () * 3 // 5 // 50 * 50 AS first,
  row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END,
    source = 'CRM', file_name, raw_row_index, field_no) AS place FROM disc)
SELECT discrepancy_type, pan, severity, field_name, raw_row_index FROM ranked WHERE place > first AND place <= first + 50""")
def deep_page(spark, folder):
    """A page beyond half of a stored run's results."""
    path = stored_run(spark, folder)
    number = stored_order(spark, path, "r").count() * 3 // 5 // 50 + 1
    rows = stored_page(spark, path, "r", number=number, size=50)
    return rows.select("discrepancy_type", "pan", "severity", "field_name", "raw_row_index")


@query("indexed_search", f"""{FLOW} SELECT discrepancy_type, pan, explanation FROM disc
WHERE contains(lower(pan), '012') OR contains(lower(explanation), '012')""")
def indexed_search(spark, folder):
    """Results of a stored run that hold a text, by the index over their trigrams."""
    return stored_search(spark, stored_run(spark, folder), "r", "012").select("discrepancy_type", "pan", "explanation")


BOOK_ROWS = 5_000  # rows of a workbook; their number grows with the table
BOOK_COLUMNS = ["pan", "investor_name", "mobile", "email", "total_amount"]


def client_books(spark, folder):
    """The paths of workbooks that hold the clients, each with a sheet of notes after them."""
    cells = crm_table(spark, folder).select(
        F.floor(F.col("crm_order") / BOOK_ROWS).alias("book"), "crm_order", *BOOK_COLUMNS[:-1], F.col("total_amount").cast("double"))
    notes = {"Notes": [["Remark"], ["not a client"], [1e21]]}
    return write_books(cells, f"{scratch_folder(spark)}/{uuid.uuid4().hex}", "book", "crm_order", notes)


@query("scan_workbook", f"""{BASE} SELECT CAST(crm_order // {BOOK_ROWS} AS BIGINT) AS book,
  row_number() OVER (PARTITION BY crm_order // {BOOK_ROWS} ORDER BY crm_order) - 1 AS row_no, pan, investor_name, mobile, email,
  CAST(total_amount AS DOUBLE) AS total_amount FROM crm""")
def scan_workbook(spark, folder):
    """Clients written as workbooks and read back from the first sheets."""
    paths = [r.path for r in client_books(spark, folder).collect()]
    rows = workbook.workbook_rows(spark, paths)
    found = workbook.scan_workbook(rows, [r.path for r in workbook.sheet_summary(rows).collect()], BOOK_COLUMNS)
    return found.select(
        F.regexp_extract("_file_name", r"_(\d+)", 1).cast("long").alias("book"), F.col("_row").alias("row_no"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(BOOK_COLUMNS[:-1])], F.col("_c4").cast("double").alias("total_amount"))


@query("workbook_sheets", f"""{BASE}, b AS (SELECT DISTINCT crm_order // {BOOK_ROWS} AS book FROM crm)
SELECT CAST(book AS BIGINT) AS book, 'Clients,Notes' AS sheets, '{",".join(BOOK_COLUMNS)}' AS header, 'Remark' AS notes_header FROM b""")
def workbook_sheets(spark, folder):
    """Names and headers of the sheets of every workbook."""
    rows = workbook.workbook_rows(spark, [r.path for r in client_books(spark, folder).collect()])
    book = F.regexp_extract("path", r"book_(\d+)\.xlsx$", 1).cast("long").alias("book")
    first = workbook.sheet_summary(rows).select(book, F.array_join("sheets", ",").alias("sheets"), F.array_join("header", ",").alias("header"))
    notes = workbook.sheet_summary(rows, "Notes").select(book, F.array_join("header", ",").alias("notes_header"))
    return first.join(notes, "book")


# Every third file has a header that names no source, and every third one lacks a column of names.
HEADERS = ("PAN,Investor Name,Folio Number,Amount", "Alpha,Beta,Gamma,Delta", "PAN,Nobody,Folio Number,Amount")
FILE_ROWS = 100  # rows of a file; their number grows with the table


def report_files(spark, folder):
    """The paths of delimited files that hold the report rows, beside one of a kind that is not read."""
    def render(rows: pd.DataFrame) -> tuple[str, bytes]:
        number = int(rows["file_no"].iloc[0])
        cells = rows.sort_values("raw_row_index")[["pan", "investor_name", "folio_number", "total_amount"]]
        lines = [HEADERS[number % 3], *(",".join(map(str, r)) for r in cells.itertuples(index=False))]
        return f"part_{number:05d}.{'txt' if number % 7 == 6 else 'csv'}", ("\n".join(lines) + "\n").encode()

    rows = report_table(spark, folder).select(
        F.floor(F.col("raw_row_index") / FILE_ROWS).alias("file_no"), "raw_row_index", "pan", "investor_name", "folio_number", "total_amount")
    place = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    return place, [r.path for r in write_files(rows, place, "file_no", render).collect()]


FILES_SQL = f"""{BASE}, f AS (SELECT raw_row_index // {FILE_ROWS} AS file_no, * FROM rep),
files AS (SELECT file_no, concat('part_', lpad(CAST(file_no AS VARCHAR), 5, '0'), CASE WHEN file_no % 7 = 6 THEN '.txt' ELSE '.csv' END) AS file_name,
  concat(CASE file_no % 3 WHEN 0 THEN '{HEADERS[0]}' WHEN 1 THEN '{HEADERS[1]}' ELSE '{HEADERS[2]}' END, chr(10),
    string_agg(concat_ws(',', pan, investor_name, folio_number, CAST(total_amount AS VARCHAR)), chr(10) ORDER BY raw_row_index), chr(10)) AS content,
  count(*) AS n FROM f GROUP BY file_no)"""


@query("folder_batch", FILES_SQL + "SELECT file_name, length(content) AS size FROM files WHERE file_name LIKE '%.csv'")
def folder_batch(spark, folder):
    """The files of a folder that can be read, with their sizes."""
    found = files.list_batch(spark, report_files(spark, folder)[0])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "size")


@query("file_fingerprints", FILES_SQL + "SELECT file_name, sha256(content) AS sha256 FROM files")
def file_fingerprints(spark, folder):
    return files.fingerprint(spark, report_files(spark, folder)[1]).select("file_name", "sha256")


@query("failed_files", FILES_SQL + """
SELECT file_name, 'UNKNOWN' AS source, 'PARSER_DETECTION_ERROR' AS failure_type, CASE WHEN file_name LIKE '%.txt'
  THEN 'Unsupported extension for auto-detection: .txt' ELSE concat('Could not auto-detect report source for file: ', file_name) END AS message
FROM files WHERE file_no % 3 = 1 OR file_name LIKE '%.txt'
UNION ALL SELECT file_name, 'CAMS', 'PARSER_ERROR', 'Missing required columns: Investor Name' FROM files WHERE file_no % 3 = 2 AND file_name LIKE '%.csv'""")
def failed_files(spark, folder):
    """Files that cannot be used become rows; the others are read."""
    _, failed = load_reports(spark, report_files(spark, folder)[1])
    return sinks.failed_files_table(spark, failed)


@query("surviving_files", FILES_SQL + """, g AS (SELECT * FROM files WHERE file_no % 3 = 0 AND file_name LIKE '%.csv')
SELECT g.file_name, 'CAMS' AS source, row_number() OVER (PARTITION BY file_no ORDER BY raw_row_index) + 1 AS raw_row_index,
  pan, investor_name, folio_number, CAST(total_amount AS DOUBLE) AS total_amount FROM f JOIN g USING (file_no)""")
def surviving_files(spark, folder):
    """Rows of the files that can be used, whatever becomes of the others."""
    parsed, _ = load_reports(spark, report_files(spark, folder)[1])
    return parsed.select("file_name", "source", "raw_row_index", "pan", "investor_name", "folio_number",
                         F.col("total_amount").cast("double").alias("total_amount"))


@query("map_headers", f"""{BASE} SELECT crm_client_id, pan, investor_name, email, crm_client_id AS mobile FROM crm""")
def map_headers(spark, folder):
    """Headers that read alike: of two spellings the later column counts."""
    raw = crm_table(spark, folder).select(
        F.lit("first").alias("P A N"), F.col("investor_name").alias("Client-Name"), F.col("pan").alias("pan"),
        F.col("email").alias("E-mail  Address"), F.col("crm_client_id").alias("Contact Number"), F.col("crm_client_id").alias("id"),
        F.col("crm_order").alias("_row"), F.lit("crm.csv").alias("_file_name"), F.lit("in").alias("_file_id"))
    return parse_table(raw, "CRM").select("crm_client_id", "pan", "investor_name", "email", "mobile")


@query("json_output", f"""{FLOW} SELECT discrepancy_type, pan, field_name, crm_value, report_value, severity, explanation, source FROM disc""")
def json_output(spark, folder):
    """Results written as JSON lines and read back."""
    r = flow(spark, folder)
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    statistics = metrics.breakdown_by_type(r.discrepancies)
    sinks.write_json(statistics, {"discrepancies": r.discrepancies.drop("phase", "field_no")}, path, "r")
    back = spark.read.json(f"{path}/json/discrepancies/run_id=r")
    return back.select("discrepancy_type", "pan", "field_name", "crm_value", "report_value", "severity", "explanation", "source")


@query("dlq_output", PARSED_ORACLE + """
SELECT 'parse' AS stage, 'PARSE_ERROR' AS failure_type, crm_order + 2 AS row_number, reason AS message, pan_no AS raw_pan FROM t WHERE reason <> ''""")
def dlq_output(spark, folder):
    """Rejected rows in the stored dead-letter table, with their raw cells."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_tables({"dlq": prepare(parsed_rows(spark, folder), "report", CONFIG).dlq}, path, "r")
    dlq = spark.read.parquet(f"{path}/tables/dlq/run_id=r").filter("stage = 'parse'")
    return dlq.select("stage", "failure_type", "row_number", "message", F.try_element_at("raw_data", F.lit("PAN_NO")).alias("raw_pan"))


@query("merged_breakdown", f"""{FLOW}, b AS (SELECT source, count(*) AS processed, count(*) FILTER (WHERE route <> 'UNMATCHED') AS matched FROM aligned GROUP BY source)
SELECT source, processed, matched, TRUE AS close FROM b""")
def merged_breakdown(spark, folder):
    """Distinct clients with a discrepancy over two stored runs, from their sketches, within four standard
    deviations (2.6 %) of the exact number."""
    r = flow(spark, folder)
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    for run_id, rest in (("a", 0), ("b", 1)):  # every client has rows in both runs
        some = r.aligned.filter(F.col("raw_row_index") % 2 == rest)
        sinks.write_tables({"source_sketches": metrics.source_sketches(some, r.discrepancies)}, path, run_id)
    exact = metrics.source_breakdown(r.aligned, r.discrepancies).select("source", F.col("discrepancies").alias("exact"))
    merged = stored_breakdown(spark, path, ["a", "b"]).join(exact, "source")
    close = F.abs(F.col("discrepancies") - F.col("exact")) <= F.col("exact") * 0.026 + 1
    return merged.select("source", "processed", "matched", close.alias("close"))
