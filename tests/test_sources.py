"""Files, workbooks, statements: scans, row numbers, detection, headers."""

import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.errors import SchemaMismatchError
from tallyframe.operators.parse import parse_table, split_parsed
from tallyframe.sources import catalog, files, statements, workbook


def xlsx(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(
                    f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else
                    f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
                    for c, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_map_headers():
    m = catalog.map_headers(["PAN No", "Client Name", "Contact Number", "E-mail Address", "id", "x"], catalog.ALIASES["CRM"])
    assert m == {"pan": "PAN No", "investor_name": "Client Name", "mobile": "Contact Number",
                 "email": "E-mail Address", "crm_client_id": "id"}
    with pytest.raises(SchemaMismatchError, match="Missing required columns: PAN, Investor Name"):
        catalog.map_headers(["foo"], catalog.ALIASES["CAMS"])
    assert catalog.map_headers(["P A N", "pan", "name"], catalog.ALIASES["CRM"])["pan"] == "pan"
    assert catalog.map_headers(["key", "who"], {"pan": ("key",), "investor_name": ("who",)}) == {"pan": "key", "investor_name": "who"}


def test_detect_source(spark):
    cases = [
        ("a.csv", ["PAN", "Policy No"], [], "INSURANCE"),
        ("kfintech_1.csv", ["PAN"], [], "KFINTECH"),
        ("x.csv", ["BSE_PAN"], [], "BSE"),
        ("nse.csv", ["PAN"], [], "NSE"),
        ("x.csv", ["PAN", "Folio"], [], "CAMS"),
        ("x.csv", ["PAN"], [], None),
        ("x.pdf", [], [], "PDF_CAS"),
        ("x.xlsx", ["PAN"], ["Sheet1", "Karvy data"], "KFINTECH"),
        ("x.xlsx", ["PAN", "folio"], ["Sheet1"], "CAMS"),
        ("x.doc", ["PAN", "folio"], [], None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, f string, h array<string>, s array<string>")
    out = df.select("i", catalog.detect_source(F.col("f"), F.col("h"), F.col("s")).alias("o"),
                    catalog.detection_failure(F.col("f")).alias("m")).orderBy("i").collect()
    assert [r.o for r in out] == [c[3] for c in cases]
    assert out[5].m == "Could not auto-detect report source for file: x.csv"
    assert out[9].m == "Unsupported extension for auto-detection: .doc"


def test_register_source():
    try:
        catalog.register_source("  mine ", {"pan": ("key",), "investor_name": ("who",)}, in_headers=["Who"])
        assert catalog.aliases_of("mine")["pan"] == ("key",)
        assert catalog.SIGNATURES[0] == catalog.Signature("MINE", ("who",))
    finally:
        catalog.ALIASES.pop("MINE")
        catalog.SIGNATURES.pop(0)


def test_csv_row_numbers_over_splits(spark, tmp_path):
    for name, rows in (("a.csv", 5000), ("b.csv", 3000)):
        (tmp_path / name).write_text("PAN,Name\n" + "".join(f"P{i},N{i}\n" + ("\n" if i % 50 == 0 else "") for i in range(rows)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = files.scan_csv(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")], ["PAN", "Name"])
        rows = df.collect()
        assert df.rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 8000
    assert all(r._c0 == f"P{r._row}" and r._c1 == f"N{r._row}" for r in rows)
    assert {r._file_name for r in rows} == {"a.csv", "b.csv"} and rows[0]._file_id == tmp_path.name


def test_csv_encoding_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("PAN,Name\r\nA,José\r\nB,\"x, \"\"y\"\"\"\r\n".encode("latin-1"))
    (tmp_path / "utf8.csv").write_bytes("﻿PAN,Name\nA,José\nB,Zoë\n".encode())
    (tmp_path / "multi.csv").write_text('PAN,Name\nA,"two\nlines"\nB,one\n')
    paths = [str(tmp_path / n) for n in ("latin.csv", "utf8.csv", "multi.csv")]
    got = {(r._file_name, r._row): r._c1 for r in files.scan_csv(spark, paths, ["PAN", "Name"]).collect()}
    assert got == {
        ("latin.csv", 0): "José", ("latin.csv", 1): 'x, "y"', ("utf8.csv", 0): "José", ("utf8.csv", 1): "Zoë",
        ("multi.csv", 0): "two\nlines", ("multi.csv", 1): "one",
    }
    heads = {r.file_name: r for r in files.probe(spark, [*paths, str(tmp_path / "none.csv")]).collect()}
    assert heads["utf8.csv"].header_line == "PAN,Name" and not heads["none.csv"].readable
    marks = {r.file_name: r.sha256 for r in files.fingerprint(spark, paths).collect()}
    assert marks["latin.csv"] == hashlib.sha256((tmp_path / "latin.csv").read_bytes()).hexdigest()


def test_list_batch(spark, tmp_path):
    for n in ("a.csv", "b.TXT", "c.PDF", "d.xlsx"):
        (tmp_path / n).write_text("x")
    assert {r.path.rsplit("/", 1)[1] for r in files.list_batch(spark, str(tmp_path)).collect()} == {"a.csv", "c.PDF", "d.xlsx"}


def test_split_header():
    assert files.split_header('PAN,"Name, full",PAN,') == ["PAN", "Name, full", "PAN.1", "Unnamed: 3"]


def test_workbook(spark, tmp_path):
    book, bad = tmp_path / "book.xlsx", tmp_path / "bad.xlsx"
    xlsx(book, {"Data": [["PAN", "Name", "Amount"], ["ABCDE1234F", "Asha", 12.5], ["ABCDE1234G", None, 3]], "CAMS": [["x"]]})
    bad.write_text("CORRUPTED TEXT EXCEL")
    rows = workbook.workbook_rows(spark, [str(book), str(bad)])
    info = {r.path.rsplit("/", 1)[1]: r for r in workbook.sheet_summary(rows).collect()}
    assert info["book.xlsx"].sheets == ["Data", "CAMS"] and info["book.xlsx"].header == ["PAN", "Name", "Amount"]
    assert info["bad.xlsx"].error.startswith("BadZipFile")
    path = [r.path for r in rows.select("path").distinct().collect() if r.path.endswith("book.xlsx")]
    got = workbook.scan_workbook(rows, path, ["PAN", "Name", "Amount"]).orderBy("_row").collect()
    assert [(r._c0, r._c1, r._c2, r._row) for r in got] == [("ABCDE1234F", "Asha", "12.5", 0), ("ABCDE1234G", None, "3", 1)]


def raw_table(spark, headers, rows, name="cams.csv"):
    cols = ", ".join(f"`{h}` string" for h in headers)
    return spark.createDataFrame([(*r, i, name, "in") for i, r in enumerate(rows)], f"{cols}, _row bigint, _file_name string, _file_id string")


def test_parse_crm(spark):
    raw = raw_table(
        spark, ["PAN", "Investor Name", "Mobile", "Email", "KYC", "Total Amount", "Client ID", "Tax Status"],
        [
            ["ABCDE1234F", " Asha ", "9876543210.0", "a@x.org", "k", "1,234.50", None, "On behalf of Minor"],
            [None, "B", None, None, None, "1", "C1", None],
            ["n/a", "-", None, None, None, "1", "C1", None],
            ["ABCDE1234G", "C", "N/A", "bad", "?", None, "C2", None],
            ["ABCDE1234H", "D", "", "", "NA", "abc", "C3", None],
        ],
    )
    ok, bad = split_parsed(parse_table(raw, "CRM"))
    row = ok.collect()
    assert len(row) == 1
    r = row[0]
    assert (r.investor_name, r.mobile, r.kyc_status, r.kyc_status_raw, float(r.total_amount)) == ("Asha", "9876543210", "VERIFIED", "k", 1234.5)
    assert r.crm_client_id == "AUTO_GEN_cfcd2084" and r.is_minor_account and r.total_amount_text == "1234.50"
    reasons = {b.row_number: b.reason for b in bad.collect()}
    assert reasons == {
        3: "Missing required fields: PAN",
        4: "Missing required fields: PAN, Investor Name",
        5: "email: value is not a valid email address; total_amount: Decimal input should be an integer, float, string or Decimal object",
        6: "total_amount: Input should be a valid decimal",
    }


def test_parse_split_layout_and_presence(spark):
    raw = raw_table(
        spark,
        ["Primary Holder First Name", "Primary Holder Middle Name", "Primary Holder Last Name", "Primary Holder PAN",
         "Indian Mobile No.", "Address 1", "Address 2", "City", "Nominee 1 Relationship", "Nominee 1 Applicable(%)",
         "Primary Holder KYC Type", "Client Code"],
        [["Asha", None, " Rao  K", "ABCDE1234F", "9876543210", "1 Road", None, "Pune", "Spouse", "100", "K", "007"],
         ["B", "C", "D", "ABCDE1234G", None, None, None, None, None, None, None, None]], "bse.csv")
    rows = parse_table(raw, "BSE").orderBy("raw_row_index").collect()
    a, b = rows
    assert a.investor_name == "Asha Rao K" and a.pan == "ABCDE1234F" and a.mobile == "9876543210"
    assert a.registered_address == "1 Road, Pune" and a.nominee_relation == "Spouse / 100%" and a.kyc_status == "VERIFIED"
    assert a.folio_number == "007" and a.raw_row_index == 2 and a.source == "BSE"
    assert a.missing_fields == ["email", "fatca_status", "investor_status", "last_transaction_date", "total_amount"]
    assert b.investor_name == "B C D" and b.empty_fields == ["mobile", "kyc_status"] and b.registered_address is None


def greedy(entries):
    blocks, current = [], {}
    for key, value in entries:
        if key in current:
            blocks.append(current)
            current = {}
        current[key] = value
    return blocks + ([current] if current else [])


LINE = {"pan": "PAN: ABCDE{:04d}F", "investor_name": "Investor Name: N{}", "mobile": "Mobile: 98765{:05d}",
        "folio_number": "Folio Number: F{}", "email": "Email: u{}@x.org", "total_amount": "Amount: {}"}


@pytest.mark.parametrize("stretch", [1, 2, 7, 40, 20_000])
def test_statement_blocks_against_sequential_rule(spark, stretch):
    rng = random.Random(stretch)
    lines, want = [], {}
    for f in range(3):
        entries = []
        for n in range(150):
            key = rng.choice(list(LINE))
            text = LINE[key].format(n)
            lines.append(("in", f"s{f}.pdf", n * 3, text))
            value = text.split(": ")[1]
            entries.append((key, "N" if key == "investor_name" else value))
        want[f"s{f}.pdf"] = greedy(entries)
    df = spark.createDataFrame(lines, "file_id string, file_name string, line_no bigint, line string")
    got = statements.statement_blocks(df, stretch).collect()
    for name, blocks in want.items():
        mine = [r.entries for r in sorted((r for r in got if r.file_name == name), key=lambda r: r.block_no)]
        assert mine == blocks


def test_parse_statements(spark):
    text = ["Investor Name: Asha Rao", "PAN: abcde1234f", "Mobile: +91 98765 43210", "Amount: 1,000.50", "Folio Number: 12/34",
            "", "Investor Name: B", "Holding ABCDE1234G here", "Tax Status: Minor", "Investor Name: lost"]
    df = spark.createDataFrame([("in", "s.pdf", i, t) for i, t in enumerate(text)], "file_id string, file_name string, line_no bigint, line string")
    ok, bad = split_parsed(statements.parse_statements(df))
    a, b = ok.orderBy("raw_row_index").collect()
    assert (a.pan, a.investor_name, a.mobile, float(a.total_amount), a.folio_number, a.raw_row_index) == (
        "ABCDE1234F", "Asha Rao", "9876543210", 1000.5, "12/34", 1)
    assert a.missing_fields == ["email", "kyc_status", "fatca_status", "investor_status", "last_transaction_date"]
    assert b.is_minor_account and b.pan == "ABCDE1234G" and float(b.total_amount) == 0
    assert [(r.row_number, r.reason) for r in bad.collect()] == [(3, "Missing required fields: PAN")]


def test_changed_split_layout_loses_no_row(spark, tmp_path):
    """The number of splits may change between building and running a plan, as executors come and go."""
    path = tmp_path / "big.csv"
    path.write_text("PAN,Name\n" + "".join(f"P{i},N{i}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        df = files.scan_csv(spark, [str(path)], ["PAN", "Name"])
        spark.conf.set("spark.sql.files.minPartitionNum", "9")
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 60_000 and all(r._c0 == f"P{r._row}" for r in rows)


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_quoted_line_ends_over_splits_match_the_csv_module(spark, tmp_path, split):
    import csv
    import io

    rng = random.Random(split)
    text, cells = io.StringIO(), ["plain", "two\nlines", 'say "hi"', 'a,b', "", "x\n\ny", 'end"', "\n"]
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(["PAN", "Name", "More"])
    for i in range(400):
        writer.writerow([f"P{i}", rng.choice(cells), rng.choice(cells)])
    body = text.getvalue() + 'P400,SHOP 5" PIPE,stray\n\n' + "".join(f"P{i},n,m\n" for i in range(401, 500))
    path = tmp_path / "q.csv"
    path.write_text(body)
    want = [r for r in csv.reader(io.StringIO(body)) if r][1:]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.scan_csv(spark, [str(path)], ["PAN", "Name", "More"])
        got = [[r._c0, r._c1 or "", r._c2 or ""] for r in sorted(df.collect(), key=lambda r: r._row)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 500 and [r[0] for r in got] == [r[0] for r in want]
    assert [[c.strip() for c in r] for r in got] == [[c.strip() for c in r] for r in want]


def test_header_of_any_length(spark, tmp_path):
    names = [f"column {i}" for i in range(9000)]
    (tmp_path / "long.csv").write_text("\n" * 70_000 + ",".join(names) + "\n1\n")
    (tmp_path / "lines.csv").write_text('PAN,"Investor\nName",x\nA,B,C\n')
    (tmp_path / "stray.csv").write_text('PAN,5" pipe\nA,B\n')
    got = {r.file_name: r for r in files.probe(spark, [str(tmp_path / n) for n in ("long.csv", "lines.csv", "stray.csv")]).collect()}
    assert files.split_header(got["long.csv"].header_line)[-1] == "column 8999"
    assert files.split_header(got["lines.csv"].header_line) == ["PAN", "Investor\nName", "x"]
    assert got["stray.csv"].header_line == 'PAN,5" pipe'


def test_workbook_cell_kinds(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="A" sheetId="1" r:id="rId1"/><sheet name="B" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in (1, 2)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>H</t></is></c></row>'
                   '<row><c><v>9.87654321E9</v></c><c s="1"><v>33000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>12.5</v></c><c s="1"><v>59</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>7</v></c></row><row r="2"><c r="A2"><v>1E-3</v></c></row></sheetData></worksheet>')
    rows = workbook.workbook_rows(spark, [str(tmp_path / "b.xlsx")])
    path = [rows.first().path]
    got = workbook.scan_workbook(rows, path, ["a", "b", "c", "d", "e"]).collect()
    assert [(r._c0, r._c1, r._c2, r._c3, r._c4, r._row) for r in got] == [("9876543210", "1990-05-07", "2023-03-15 12:00:00", "12.5", "1900-02-28", 0)]
    assert workbook.scan_workbook(rows, path, ["a"], "B").first()._c0 == "0.001"
    assert workbook.sheet_summary(rows, "B").first().header == ["7"]
    assert workbook.sheet_summary(rows, "C").first().error == "no sheet named C"


def test_statement_with_no_break_spaces(spark):
    text = ["Investor\u00a0Name\u00a0: X", "Investor Name\u00a0:\u00a0Asha Rao", "PAN\u00a0: ABCDE1234F"]
    df = spark.createDataFrame([("in", "s.pdf", i, t) for i, t in enumerate(text)], "file_id string, file_name string, line_no bigint, line string")
    assert [r.investor_name for r in statements.parse_statements(df).orderBy("raw_row_index").collect()] == ["X", "Asha Rao"]


def test_folders_are_expanded(spark, tmp_path):
    for n in ("a.csv", "b.txt", "c.xlsx"):
        (tmp_path / n).write_text("x")
    got = files.expand(spark, [str(tmp_path), "elsewhere/z.csv"])
    assert [p.rsplit("/", 1)[1] for p in got] == ["a.csv", "c.xlsx", "z.csv"]


def test_amounts_beyond_ten_decimals_are_refused_by_name(spark):
    raw = raw_table(spark, ["PAN", "Investor Name", "Total Amount", "Folio"], [
        ["ABCDE1234F", "A", "1.12345678901", "1"], ["ABCDE1234F", "A", "1.1234567890", "2"], ["ABCDE1234F", "A", "2.5000000000000", "3"]])
    ok, bad = split_parsed(parse_table(raw, "CAMS"))
    assert [r.reason for r in bad.collect()] == ["total_amount: more than 10 decimals"] and ok.count() == 2


def test_cells_beyond_the_header_reject_the_row(spark, tmp_path):
    (tmp_path / "cams.csv").write_text(
        'PAN,Name\nABCDE1234A,x,EXTRA,MORE\nABCDE1234B,"a,b"\nABCDE1234C,c,,\nABCDE1234D,d,,"late"\nABCDE1234E\n'
        'ABCDE1234F,"q ""r"", s",""\nABCDE1234G,"n\nm",z\n')
    raw = files.scan_csv(spark, [str(tmp_path / "cams.csv")], ["PAN", "Name"])
    assert {r._c0[-1]: r._beyond for r in raw.collect()} == {
        "A": "EXTRA,MORE", "B": None, "C": None, "D": ',"late"', "E": None, "F": None, "G": "z"}
    accepted, rejected = split_parsed(parse_table(raw, "CAMS", headers=["PAN", "Name"]))
    assert {r.pan[-1] for r in accepted.collect()} == {"B", "C", "F"}
    assert {r.pan[-1] for r in rejected.filter("reason = 'Expected 2 cells, the row has more'").collect()} == {"A", "D", "G"}


def test_large_sheet_is_streamed(tmp_path):
    """A sheet is never held whole, nor is the file: only pieces of it are read."""
    import tracemalloc

    from tallyframe.sources import xlsx

    n, path = 60_000, tmp_path / "big.xlsx"
    xlsx_rows = [[f"NAME {i}", i * 1.5, None, f"text {i % 7}"] for i in range(n)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        body = "".join(f"<row><c t='inlineStr'><is><t>{a}</t></is></c><c><v>{b}</v></c><c/><c t='s'><v>{i % 7}</v></c></row>"
                       for i, (a, b, _, _) in enumerate(xlsx_rows))
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='S' id='r1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R><Relationship Id='r1' Target='s.xml'/></R>")
        z.writestr("xl/s.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>text {i}</t></si>" for i in range(7)) + "</sst>")
        size = len(body)
        del body
    seen = 0
    with files.open_at_random(str(path)) as file:
        tracemalloc.start()
        book = xlsx.open_book(file)
        shared = xlsx.shared_strings(file, book.shared)
        for (number, cells), row in zip(xlsx.sheet_rows(file, book.sheets[0].part, shared, set(), False), xlsx_rows):
            assert cells == [row[0], str(row[1]), None, row[3]]
            seen = number
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert seen == n and size > 5 << 20 and peak < 2 * xlsx.READ + (3 << 20), (size, peak)


def test_sheets_are_tasks_of_their_own(spark, tmp_path):
    sheets = {f"Sheet {k}": [["PAN", "Name"], *[[f"P{k}{i}", "N"] for i in range(50)]] for k in range(6)}
    xlsx(tmp_path / "many.xlsx", sheets)
    rows = workbook.workbook_rows(spark, [str(tmp_path / "many.xlsx")])
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    assert {(r.sheet, r.n) for r in rows.groupBy("sheet").agg(F.count("*").alias("n")).collect()} == {(s, 51) for s in sheets}
    assert rows.filter("sheet = 'Sheet 4' AND row_no = 3").first().cells == ["P41", "N"]


def test_good_and_broken_files_in_one_task(spark, tmp_path):
    xlsx(tmp_path / "good.xlsx", {"A": [["PAN"], ["P1"]], "B": [["x"]]})
    (tmp_path / "bad.xlsx").write_text("no book")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = workbook.workbook_rows(spark, [str(tmp_path / n) for n in ("good.xlsx", "bad.xlsx")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.sheet_no, r.row_no, r.cells[0][:10]) for r in rows} == {(0, 1, "PAN"), (0, 2, "P1"), (1, 1, "x"), (-1, 0, "BadZipFile")}


def test_sheet_broken_in_the_middle(spark, tmp_path):
    """The rows before the break come out, and the reason as a row of the file."""
    xlsx(tmp_path / "good.xlsx", {"A": [["PAN"], ["P1"]]})
    with zipfile.ZipFile(tmp_path / "good.xlsx") as good, zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as bad:
        for name in good.namelist():
            text = good.read(name).decode()
            bad.writestr(name, text.replace("</sheetData>", "<row></sheetData>") if "sheet1" in name else text)
    rows = workbook.workbook_rows(spark, [str(tmp_path / "bad.xlsx"), str(tmp_path / "none.xlsx")]).collect()
    errors = {r.path.rsplit("/", 1)[1]: r.cells[0] for r in rows if r.sheet_no == -1}
    assert "ParseError" in errors["bad.xlsx"] and "FileNotFoundError" in errors["none.xlsx"], errors
    assert [r.cells for r in rows if r.sheet_no == 0][:1] == [["PAN"]]
