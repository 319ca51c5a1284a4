"""Files in, result tables out."""

from dataclasses import replace

import pytest

from tallyframe import config_from_dict, run, standard_config
from tallyframe.config import load_config
from tallyframe.errors import ConfigurationError, FileAccessError, ParserError
from tallyframe.operators import metrics, views
from tallyframe.sources.sinks import RunHistory, output_formats, summary_text

CRM = """PAN,Investor Name,Mobile,Email,KYC Status,FATCA Status,Investor Status,Total Amount,Client ID
ABCDE1234A,Asha Rao,9876500001,asha@x.org,VERIFIED,COMPLIANT,ACTIVE,50000,C1
ABCDE1234B,Bala Iyer,9876500002,bala@x.org,VERIFIED,COMPLIANT,ACTIVE,50000,C2
ABCDE1234C,Chitra Nair,9876500003,chitra@x.org,PENDING,COMPLIANT,ACTIVE,100,C3
ABCDE1234D,Dev Shah,9876500004,dev@x.org,VERIFIED,COMPLIANT,ACTIVE,200,C4
ABCDE1234E,Esha Pal,,,UNKNOWN,UNKNOWN,ACTIVE,300,C5
ABCDE1234A,Asha Rao,9876500001,asha@x.org,VERIFIED,COMPLIANT,ACTIVE,50000,C1
BADPAN,Someone,,,,,,1,C9
,Nobody,,,,,,1,C10
"""
CAMS = """PAN,Investor Name,Folio Number,Total Amount,KYC Status,FATCA Status,Investor Status,Mobile,Email
ABCDE1234A,Mr. Asha Rao,F1,"50,000.00",K,Y,A,+91 9876500001,ASHA@x.org
ABCDE1234B,Bala Iyer,F2,48000,VERIFIED,COMPLIANT,INACTIVE,9876500002,other@x.org
ABCDE1234B,Bala Iyer,F2,48000,VERIFIED,COMPLIANT,INACTIVE,9876500002,other@x.org
ABCDE1234B,Bala Iyer,F2,47000,VERIFIED,COMPLIANT,INACTIVE,9876500002,other@x.org
ZZZZZ9999Z,Rao Chitra Nairr,F3,100,PENDING,COMPLIANT,ACTIVE,9876500003,
ZZZZZ8888Z,Unknown Person,F4,1,VERIFIED,COMPLIANT,ACTIVE,9111111112,
"""
BSE = "BSE_PAN,BSE Client Name,Amount\nABCDE1234A,Asha Rao,50000.02\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "crm.csv").write_text(CRM)
    (d / "cams.csv").write_text(CAMS)
    (d / "bse.csv").write_text(BSE)
    (d / "odd.csv").write_text("A,B\n1,2\n")
    (d / "corrupt.xlsx").write_text("CORRUPTED")
    (d / "kfintech_nohead.csv").write_text("x,y\n1,2\n")
    (d / "stmt.pdf").write_text("Investor Name: Dev Shah\nPAN: ABCDE1234D\nAmount: 200\n")
    return d


@pytest.fixture(scope="module")
def done(spark, files, tmp_path_factory):
    config = replace(standard_config(), output_directory=str(tmp_path_factory.mktemp("out")))
    config = replace(config, matching=replace(config.matching, source_overrides={"CAMS": {"fuzzy_threshold": 0.75}}))
    names = ["cams.csv", "bse.csv", "odd.csv", "corrupt.xlsx", "kfintech_nohead.csv", "stmt.pdf"]
    return run(spark, files / "crm.csv", [files / n for n in names], config, run_id="r1", run_ts="2026-01-01T00:00:00Z"), config


def test_counts(done):
    result, _ = done
    m = result.metadata.first()
    assert (m.total_crm_records, m.total_report_records, m.failed_files_count) == (8, 8, 3)
    assert len(m.crm_file_hash) == 64 and "cams.csv" in m.report_file_hashes
    kinds = {(r.file_name, r.failure_type) for r in result.failed_files.collect()}
    assert kinds == {("odd.csv", "PARSER_DETECTION_ERROR"), ("corrupt.xlsx", "PARSER_DETECTION_ERROR"),
                     ("kfintech_nohead.csv", "PARSER_ERROR")}


def test_dlq(done):
    rows = {(r.file_name, r.row_number, r.stage, r.failure_type) for r in done[0].dlq.collect()}
    assert rows == {
        ("crm.csv", 7, "duplicate", "EXACT_DUPLICATE"),
        ("crm.csv", 8, "normalize", "NORMALIZATION_ERROR"),
        ("crm.csv", 9, "parse", "PARSE_ERROR"),
        ("cams.csv", 4, "duplicate", "EXACT_DUPLICATE"),
        ("cams.csv", 5, "duplicate", "CONFLICTING_DUPLICATE"),
    }


def test_discrepancies(done):
    got = {(r.discrepancy_type, r.pan, r.field_name) for r in done[0].result.discrepancies.collect() if r.file_name == "cams.csv" or r.phase == 1}
    assert got == {
        ("AMOUNT_MISMATCH", "ABCDE1234B", "total_amount"),
        ("STATUS_MISMATCH", "ABCDE1234B", "investor_status"),
        ("EMAIL_MISMATCH", "ABCDE1234B", "email"),
        ("PAN_MISMATCH", "ZZZZZ9999Z", "pan"),
        ("NAME_MISMATCH", "ZZZZZ9999Z", "investor_name"),
        ("FIELD_EMPTY", "ZZZZZ9999Z", "email"),
        ("FUZZY_MATCH_WARNING", "ZZZZZ9999Z", None),
        ("MISSING_IN_CRM", "ZZZZZ8888Z", None),
        ("INCOMPLETE_CRM_RECORD", "ABCDE1234E", None),
    }
    bse = [r for r in done[0].result.discrepancies.collect() if r.file_name == "bse.csv"]
    assert {r.field_name for r in bse} == {"email", "kyc_status", "fatca_status", "investor_status"}
    assert {r.discrepancy_type for r in bse} == {"FIELD_MISSING"}
    assert [r.explanation for r in bse if r.field_name == "email"] == [
        "Email column missing from BSE source file. CRM value 'asha@x.org' could not be compared."]
    stmt = {(r.field_name, r.discrepancy_type) for r in done[0].result.discrepancies.collect() if r.file_name == "stmt.pdf"}
    assert stmt == {("mobile", "FIELD_MISSING")}
    amount = [r for r in done[0].result.discrepancies.collect() if r.discrepancy_type == "AMOUNT_MISMATCH"][0]
    assert amount.explanation == "Amount mismatch detected. CRM value 50000.00 differs from Report value 48000.00."
    assert (amount.crm_value, amount.report_value, amount.severity) == ("50000", "48000", "CRITICAL")
    assert amount.source_info == {"file_name": "cams.csv", "file_id": amount.file_id, "raw_row_index": "3", "folio_number": "F2"}
    assert amount.audit_trace.skipped_comparisons == ["DATE_COMPARISON_SKIPPED"]


def test_core_fields_only(spark, files):
    config = standard_config()
    r = run(spark, files / "crm.csv", [files / "bse.csv"], config, keep_extended=False, write=False)
    kinds = {x.discrepancy_type for x in r.result.discrepancies.collect() if x.phase == 0}
    assert "FIELD_MISSING" not in kinds and "EMAIL_MISMATCH" in kinds and "KYC_MISMATCH" in kinds


def test_written_outputs(spark, done):
    result, config = done
    folder = config.output_directory
    back = spark.read.option("header", True).csv(f"{folder}/csv/discrepancies/run_id=r1")
    assert back.count() == result.result.discrepancies.count()
    assert back.columns == ["discrepancy_type", "pan", "field_name", "crm_value", "report_value", "severity",
                            "explanation", "file_name", "raw_row_index", "folio_number"]
    un = spark.read.option("header", True).csv(f"{folder}/csv/unmatched/run_id=r1")
    assert {(r.record_type, r.pan) for r in un.collect()} == {("REPORT", "ZZZZZ8888Z"), ("CRM", "ABCDE1234E")}
    matched = spark.read.option("header", True).csv(f"{folder}/csv/matched/run_id=r1")
    assert len(matched.columns) == 13 and matched.count() == 5
    assert spark.read.json(f"{folder}/json/statistics/run_id=r1").first().matched_records == 5
    stored = spark.read.parquet(f"{folder}/tables/discrepancies")
    assert stored.filter("run_id = 'r1'").count() == back.count()


def test_summary_text(done):
    result, _ = done
    types = [(r["discrepancy_type"], r["count"]) for r in metrics.breakdown_by_type(result.result.discrepancies).collect()]
    text = summary_text(result.summary.first().asDict(), types)
    assert "Total CRM Records: 8\nTotal Report Records: 8\nMatched Records: 5\nMissing In CRM: 1" in text
    assert " - AMOUNT_MISMATCH: 1" in text and "Failed Files: 3" in text
    assert " - No discrepancies detected." in summary_text(result.summary.first().asDict(), [])


def test_matrix_and_actions(done):
    result, config = done
    long = views.field_matrix_long(result.result.aligned, config)
    matrix = views.field_matrix(long, "ABCDE1234B", duplicates=result.reports.duplicates)
    assert matrix.columns[:2] == ["field", "CRM (reference)"] and "CAMS/KFintech (code F2)" in matrix.columns
    rows = {r.field: r for r in matrix.collect()}
    assert rows["Email"]["CRM (reference)"] == "bala@x.org" and rows["Email"]["CAMS/KFintech (code F2)"] == "other@x.org"
    assert len(matrix.columns) == 5  # field, CRM, the row and its two rejected copies
    pages = [views.field_matrix(long, "ABCDE1234B", duplicates=result.reports.duplicates, page=k, per_page=2).columns[2:] for k in range(3)]
    assert pages[0] + pages[1] == matrix.columns[2:] and [len(p) for p in pages] == [2, 1, 0]
    cells = {(r.pan, r.file_name, r.field): r.status for r in long.collect()}
    assert cells[("ABCDE1234B", "cams.csv", "Email")] == "mismatch" and cells[("ABCDE1234B", "cams.csv", "Name")] == "match"
    assert cells[("ABCDE1234A", "bse.csv", "Email")] == "none"
    assert cells[("ABCDE1234C", "cams.csv", "Email")] == "verify"
    actions = views.action_list(result.result.discrepancies, result.reports.duplicates, "Bala").collect()
    assert actions[0].severity == "CRITICAL"
    assert any(a.field_record == "Duplicate record, code 'F2'" and a.found_value == "Duplicate row 4 found in CAMS" for a in actions)


def test_missing_paths_are_fatal(spark, files, tmp_path):
    with pytest.raises(FileAccessError):
        run(spark, tmp_path / "no.csv", [], standard_config(), write=False)
    with pytest.raises(FileAccessError):
        run(spark, files / "crm.csv", [tmp_path / "no.csv"], standard_config(), write=False)
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ParserError):
        run(spark, tmp_path / "empty.csv", [], standard_config(), write=False)


def test_history(spark, tmp_path):
    history = RunHistory(spark, str(tmp_path / "runs"))
    assert history.save({"match_rate_percent": 99.5, "discrepancy_count": 3}, "t1", "crm.csv", 2) == "RUN-001"
    assert history.save({"match_rate_percent": 90.0, "discrepancy_count": 7}, "t2", "crm.csv", 2) == "RUN-002"
    assert [r.run_id for r in history.list().collect()] == ["RUN-002", "RUN-001"]
    assert '"discrepancy_count": 3' in history.get("RUN-001").first().result
    assert history.get("RUN-009").count() == 0


def test_concurrent_writers_get_numbers_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def add(i):
        return RunHistory(spark, str(tmp_path / "runs")).save({"discrepancy_count": i}, f"t{i}", "crm.csv", i)

    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(add, range(8)))
    assert sorted(names) == [f"RUN-{i:03d}" for i in range(1, 9)]
    got = {r.run_id: r.discrepancy_count for r in RunHistory(spark, str(tmp_path / "runs")).list().collect()}
    assert got == {name: i for i, name in enumerate(names)}


def test_number_of_an_unfinished_run_stays_unused(spark, tmp_path):
    history = RunHistory(spark, str(tmp_path / "runs"))
    assert history._claim() == 1 and history.list().count() == 0
    assert history.save({}, "t", "crm.csv", 1) == "RUN-002"
    assert [r.run_id for r in history.list().collect()] == ["RUN-002"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("engine:\n  amount_epsilon: 0.05\nmatching:\n  enable_fuzzy_matching: true\n"
                                     "  fuzzy_secondary_keys: [mobile]\nsources:\n  CAMS:\n    compare: [pan]\n")
    c = load_config(tmp_path / "c.yaml")
    assert c.engine.amount_epsilon == 0.05 and c.matching.fuzzy_secondary_keys == ("mobile",) and c.sources["CAMS"].compare == ("pan",)
    assert c.engine.date_days_tolerance == 3 and output_formats(c) == ["excel", "csv", "json"]
    assert output_formats(config_from_dict({"reporting": {"formats": ["CSV"]}})) == ["csv"]
    with pytest.raises(FileAccessError):
        load_config(tmp_path / "none.yaml")
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ConfigurationError):
        load_config(tmp_path / "bad.yaml")
    with pytest.raises(ConfigurationError):
        config_from_dict({"engine": {"amount_epsilon": "x"}})


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    """Each file is de-duplicated by itself, delimited and workbook alike."""
    from test_sources import xlsx

    (tmp_path / "crm.csv").write_text(CRM)
    head, row = CAMS.splitlines()[:2]
    paths = []
    for month in ("jan", "feb"):
        folder = tmp_path / month / "reports"
        folder.mkdir(parents=True)
        (folder / "cams.csv").write_text(f"{head}\n{row}\n")
        pan = "ABCDE1234B" if month == "jan" else "ABCDE1234C"
        xlsx(folder / "cams2.xlsx", {"S": [["PAN", "Investor Name", "Folio Number"], [pan, f"Name {month}", "F9"]]})
        paths += [folder / "cams.csv", folder / "cams2.xlsx"]
    r = run(spark, tmp_path / "crm.csv", paths, standard_config(), write=False)
    got = sorted((x.pan, x.file_name) for x in r.reports.valid.collect())
    assert got == [("ABCDE1234A", "cams.csv")] * 2 + [("ABCDE1234B", "cams2.xlsx"), ("ABCDE1234C", "cams2.xlsx")]
    assert r.metadata.first().failed_files_count == 0 and len(r.metadata.first().report_file_hashes) == 4


@pytest.fixture(scope="module")
def masked(done, tmp_path_factory):
    from tallyframe.plans.run import write_outputs

    config = replace(done[1], output_directory=str(tmp_path_factory.mktemp("masked")),
                     reporting=replace(done[1].reporting, redact_sensitive_fields=True, redaction_key="k"))
    write_outputs(done[0], config)
    return done[0], config


def test_masked_run_leaves_no_clear_identifier(spark, masked):
    """Every written file, searched for the identifiers of the input."""
    import pathlib
    import re

    folder = pathlib.Path(masked[1].output_directory)
    names = [p for p in folder.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
    texts = [p.read_text() for p in names if p.suffix in (".csv", ".json")]
    for p in names:
        if p.suffix == ".parquet":
            texts.append(str([r.asDict(True) for r in spark.read.parquet(str(p)).collect()]))
    assert len(texts) > 10
    clear = re.compile(r"ABCDE1234[A-E]|ZZZZZ[89]{4}Z|98765000\d\d|9111111112|(?i:asha|bala|chitra|dev|other)@x\.org")
    assert [clear.search(t)[0] for t in texts if clear.search(t)] == []


def test_stored_client_is_found_in_masked_tables(spark, masked):
    from tallyframe.plans.run import stored_client

    result, config = masked
    rows = stored_client(spark, config.output_directory, "r1", [" abcde1234b "], key="k")
    clear = result.result.discrepancies.filter("pan = 'ABCDE1234B'")
    assert rows.count() == clear.count() > 0 and {r.pan for r in rows.collect()} == {"ABCDE****B"}
    assert stored_client(spark, config.output_directory, "r1", ["ABCDE1234B"], "aligned", "k").count() > 0
    assert stored_client(spark, config.output_directory, "r1", ["ABCDE1234B"], key="other").count() == 0


def test_masking_does_not_merge_findings(spark, masked):
    result, config = masked
    sheet = spark.read.option("header", True).csv(f"{config.output_directory}/csv/sheets/errors_actions/run_id=r1")
    clear = views.action_list(result.result.discrepancies, result.reports.duplicates)
    assert sheet.count() == clear.count()


def test_counts_per_file_are_written(spark, done):
    _, config = done
    counts = spark.read.parquet(f"{config.output_directory}/tables/parse_counts/run_id=r1")
    assert {(r.file_name, r.total_rows) for r in counts.collect()} == {("cams.csv", 6), ("bse.csv", 1), ("stmt.pdf", 1)}


def test_allowed_statuses_reach_a_run(spark, files):
    from tallyframe.config import Validation

    config = standard_config()
    cams = replace(config.sources["CAMS"], validations=("kyc_status",))
    config = replace(config, sources={**config.sources, "CAMS": cams}, validation=Validation(allowed_kyc_statuses=("PENDING",)))
    r = run(spark, files / "crm.csv", [files / "cams.csv"], config, write=False)
    assert r.dlq.filter("stage = 'validate' AND field_name = 'kyc_status'").count() > 0


def ledger_source():
    """A data source for files of lines `key|who|sum`, two partitions per file."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Half(InputPartition):
        def __init__(self, path, half):
            self.path, self.half = path, half

    class LedgerReader(DataSourceReader):
        def __init__(self, paths):
            self.paths = paths

        def partitions(self):
            return [Half(p, h) for p in self.paths for h in (0, 1)]

        def read(self, partition):
            with open(partition.path.removeprefix("file:")) as file:
                for i, line in enumerate(file):
                    if i % 2 == partition.half:
                        yield (*line.rstrip("\n").split("|"), i, partition.path)

    class Ledger(DataSource):
        @classmethod
        def name(cls):
            return "ledger"

        def schema(self):
            return "key string, who string, sum string, _row bigint, _file_path string"

        def reader(self, schema):
            import json

            return LedgerReader(json.loads(self.options["paths"]))

    return Ledger


def test_registered_source_with_a_reader(spark, files, tmp_path):
    from tallyframe.sources import catalog
    from tallyframe.sources.files import expand

    aliases = {"pan": ("key",), "investor_name": ("who",), "total_amount": ("sum",)}
    catalog.register_source("ledger", aliases, data_source=ledger_source(), suffixes=(".ldg",))
    try:
        for k in (1, 2):
            (tmp_path / f"{k}.ldg").write_text("ABCDE1234A|Asha Rao|50000\nABCDE1234B|Bala Iyer|1\n|nobody|2\n")
        paths = expand(spark, [str(tmp_path)])
        assert len(paths) == 2
        config = replace(standard_config(), output_directory=str(tmp_path / "out"))
        done = run(spark, files / "crm.csv", [*paths, files / "cams.csv"], config, write=False)
        rows = done.reports.parsed.filter("source = 'LEDGER'")
        assert rows.count() == 6 and rows.select("file_path").distinct().count() == 2
        assert {r.raw_row_index for r in rows.collect()} == {2, 3, 4}
        found = done.result.discrepancies.filter("source = 'LEDGER' AND discrepancy_type = 'AMOUNT_MISMATCH'").collect()
        assert [(r.pan, r.raw_row_index) for r in found] == [("ABCDE1234B", 3)] * 2
        assert done.dlq.filter("source = 'LEDGER' AND stage = 'parse'").count() == 2
    finally:
        catalog.READERS.clear()
        del catalog.ALIASES["LEDGER"]
