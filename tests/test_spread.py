"""Work that costs more than moving a row is dealt over the tasks, however few files the rows come from."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.parse import parse_table
from tallyframe.sources import statements
from tallyframe.sources.textindex import held_grams


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_parsing(apart):
    raw = apart.range(0, 400, 1, 1).select(
        F.concat(F.lit("ABCDE"), F.lpad("id", 4, "0"), F.lit("F")).alias("PAN"), F.lit("A B").alias("Client Name"),
        F.col("id").alias("_row"), F.lit("k.csv").alias("_file_name"), F.lit("in").alias("_file_id"))
    assert tasks_with_rows(parse_table(raw, "KFINTECH")) == 4


def test_statement_lines(apart):
    lines = apart.range(0, 400, 1, 1).select(
        F.lit("in").alias("file_id"), F.lit("s.pdf").alias("file_name"), F.col("id").alias("line_no"), F.lit("Name: A B").alias("line"))
    assert tasks_with_rows(statements.statement_entries(lines)) == 4


def test_trigrams(apart):
    rows = apart.range(0, 400, 1, 1).select(
        F.lit(0).alias("part"), F.col("id").alias("pos"), F.lit("ABCD").alias("pan"), F.lit(None).cast("string").alias("explanation"))
    held = held_grams(rows, ["pan", "explanation"])
    assert tasks_with_rows(held) == 4
    assert sorted(r.gram for r in held.filter("pos = 7").collect()) == ["abc", "bcd"]


def test_trigrams_are_of_code_points(apart):
    texts = ["", "ab", "abc", "ÄÖÜß 'x'", "a\U0001F600b\U0001F601c", "line\nend\r\n ok", "aaaaa"]
    rows = apart.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "part int, pos bigint, t string")
    want = {(i, t.lower()[k : k + 3]) for i, t in enumerate(texts) for k in range(len(t.lower()) - 2)}
    assert sorted((r.pos, r.gram) for r in held_grams(rows, ["t"]).collect()) == sorted(want)
