"""Registered queries on customers whose PANs repeat, as they do from 260,000 customers on."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from workload import recon

SHARED = 260_000  # keys that far apart have one PAN


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every customer three times under one PAN."""
    path = str(tmp_path_factory.mktemp("shared"))
    n = F.col("id") % 60
    spark.range(180).select(
        (n + F.floor(F.col("id") / 60) * SHARED).alias("c_custkey"), F.lit("x").alias("c_name"), (n % 5).cast("int").alias("c_nationkey"),
        (F.col("id") * 3.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{path}/customer.parquet")
    return path


def both(spark, folder, name):
    """Rows of a query and of its SQL, in columns of the same order."""
    got = entry.queries()[name](spark, folder)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    columns = ", ".join(got.columns)
    want = db.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    return {tuple(r) for r in got.collect()}, set(want)


@pytest.mark.parametrize("per_page", [2, 500])
def test_client_matrix_of_a_shared_pan(spark, folder, monkeypatch, per_page):
    monkeypatch.setattr(recon, "MATRIX_PAGE", per_page)
    got, want = both(spark, folder, "client_matrix")
    assert got == want and len(got) == 14


def test_matrix_of_a_shared_pan_in_two_folders(spark, folder):
    got, want = both(spark, folder, "matrix_same_name")
    # the SQL takes any master row of the PAN for the reference, an exact match the first one
    assert {(field, feb, jan) for field, _, feb, jan in got} == {(field, feb, jan) for field, _, feb, jan in want}
    assert dict((r[0], r[1]) for r in got)["Email"] == min(r[1] for r in got | want if r[0] == "Email")
