"""Stored tables: pages, clients and texts found without reading all rows."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import views
from tallyframe.sources import sinks
from tallyframe.sources.ordered import OrderedTable
from tallyframe.sources.textindex import IndexRule, TextIndex

N = 6_000


def leaves(plan):
    children = plan.children()
    nodes = [children.apply(i) for i in range(children.size())]
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        nodes = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        nodes = [plan.plan()]
    return [plan] if not nodes else [x for n in nodes for x in leaves(n)]


def scanned(df):
    """Rows that came out of the file scans of a query once it has run, and the rows of its result."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = plan.executeCollect()
    scans = [x for x in leaves(plan) if "FileSourceScanExec" in x.getClass().getSimpleName()]
    return sum(x.metrics().get("numOutputRows").get().value() for x in scans), len(rows)


@pytest.fixture
def many_files(spark):
    """Small tables keep several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def rows(spark):
    kind = F.when(F.col("id") % 3 == 0, "AMOUNT_MISMATCH").otherwise("NAME_MISMATCH")
    return spark.range(N).select(
        kind.alias("kind"), F.concat(F.lit("PAN"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pan"),
        F.when(F.col("id") % 7 == 0, None).otherwise(
            F.concat(F.lit("Value 'Ä"), (F.col("id") * 7919 % 10007).cast("string"), F.lit("' differs"))).alias("explanation"), "id")


def test_pages_cover_the_order_once(many_files, rows, tmp_path):
    order = [F.col("kind").desc(), F.col("id")]
    table = OrderedTable.write(rows, order, str(tmp_path / "t"))
    want = [r.id for r in rows.orderBy(*order).collect()]
    assert table.count() == N
    got = [r.id for k in (1, 2, 60) for r in table.page(k, 100).collect()]
    assert got == want[:200] + want[5_900:]
    assert [r.id for r in table.page(5, 1_300).collect()] == want[5_200:]
    assert table.page(61, 100).collect() == [] and OrderedTable(many_files, str(tmp_path / "t")).count() == N
    last = table.page(3, 100).collect()[-1]
    assert [r.id for r in table.after(last.part, last.pos, 50).collect()] == want[300:350]


def test_late_page_reads_one_range(many_files, rows, tmp_path):
    table = OrderedTable.write(rows, [F.col("id")], str(tmp_path / "t"))
    biggest = table.parts.agg(F.max("n")).first()[0]
    assert table.parts.count() > 2
    page = table.page(71, 50)
    plan = page._jdf.queryExecution().toString()
    assert "GlobalLimit" not in plan and "Offset" not in plan
    read, found = scanned(page)
    assert found == 50 and read <= 2 * biggest < N


def test_second_writer_keeps_the_first_table(many_files, rows, tmp_path):
    first = OrderedTable.write(rows, [F.col("id")], str(tmp_path / "t"))
    again = OrderedTable.write(rows.limit(10), [F.col("id")], str(tmp_path / "t"))
    assert first.count() == again.count() == N
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_empty_table(spark, rows, tmp_path):
    table = OrderedTable.write(rows.limit(0), [F.col("id")], str(tmp_path / "t"))
    assert table.count() == 0 and table.page(1, 10).collect() == []
    index = TextIndex.write(table, ["pan"], str(tmp_path / "i"))
    assert index.search("abc").collect() == [] and index.search("a").collect() == []


def test_client_reads_few_files(many_files, rows, tmp_path):
    """One client has a third of the rows and lies in several files; another is found in one."""
    pan = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("pan"))
    keyed = rows.withColumn("pan", pan).withColumn("pan_key", views.pan_key(F.col("pan"), "k"))
    sinks.write_tables({"t": keyed}, str(tmp_path), "r")
    stored = many_files.read.parquet(str(tmp_path / "tables/t/run_id=r"))
    hot = sinks.rows_of_keys(stored, [views.pan_key_text("hot", "k")])
    assert hot.count() == N / 3
    assert hot.select(F.input_file_name()).distinct().count() > 1
    one = sinks.rows_of_keys(stored, [views.pan_key_text("PAN000001 ", "k")])
    read, found = scanned(one)
    assert found == 1 and read < N / 2
    read, found = scanned(sinks.rows_of_keys(stored, [views.pan_key_text("nobody", "k")]))
    assert found == 0 and read < N / 2


def test_many_keys_are_joined(spark, rows):
    wanted = [f"PAN{i:06}" for i in range(0, 3_000)]
    assert sinks.rows_of_keys(rows, wanted, "pan").count() == 3_000
    assert views.client_extract(rows, [*wanted, " pan000001", ""]).count() == 3_000
    assert views.client_extract(rows, ["pan000001", ""]).count() == 1
    assert sinks.rows_of_keys(rows, [], "pan").count() == 0


@pytest.mark.parametrize("rule", [IndexRule(), IndexRule(common=0.4, grams=2, named_places=3)])
def test_search_equals_scan(many_files, rows, tmp_path, rule):
    table = OrderedTable.write(rows, [F.col("id")], str(tmp_path / "t"))
    index = TextIndex.write(table, ["pan", "explanation"], str(tmp_path / "i"), rule)
    for text in ("00123", "PAN0001", "ä77", "'Ä1", "differs", "value", "12", "", "nowhere", "pan000001", "7' d", "%_"):
        low = text.lower()
        want = {r.id for r in rows.collect() if low in r.pan.lower() or low in (r.explanation or "").lower()}
        found = index.search(text).collect()
        assert len(found) == len(want) and {r.id for r in found} == want, text


def test_search_reads_little(many_files, rows, tmp_path):
    table = OrderedTable.write(rows, [F.col("id")], str(tmp_path / "t"))
    index = TextIndex.write(table, ["pan", "explanation"], str(tmp_path / "i"))
    read, found = scanned(index.search("pan004321"))
    assert found == 1 and read < N / 2
    assert index.counts.filter("gram = 'pan'").first().n == N and index.postings.filter("gram = 'pan'").count() == 0
