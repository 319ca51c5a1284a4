"""Master and report tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CRM_SQL = """
SELECT CAST(c_custkey AS STRING) AS crm_client_id, CAST(c_custkey AS BIGINT) AS crm_order,
  concat('CUST', chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'),
         chr(CAST(65 + CAST(floor(c_custkey / 10000) AS BIGINT) % 26 AS INT))) AS pan,
  concat(c_mktsegment, ' HOLDER ', lpad(CAST(c_custkey AS STRING), CAST(greatest(6, length(CAST(c_custkey AS STRING))) AS INT), '0')) AS investor_name,
  CASE WHEN c_custkey % 29 = 0 THEN NULL
       ELSE concat('9', lpad(CAST((c_custkey * 7919 + 1234567) % 1000000000 AS STRING), 9, '0')) END AS mobile,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 29 = 0 THEN 'UNKNOWN' WHEN c_custkey % 5 = 0 THEN 'PENDING' ELSE 'VERIFIED' END AS kyc_status,
  CASE WHEN c_custkey % 29 = 0 THEN 'UNKNOWN' ELSE 'COMPLIANT' END AS fatca_status,
  'ACTIVE' AS investor_status,
  CAST(c_acctbal AS DECIMAL(18,2)) AS total_amount
FROM customer
"""

REP_SQL = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'CAMS' WHEN 1 THEN 'KFINTECH' ELSE 'NSE' END AS source,
  CASE c_custkey % 3 WHEN 0 THEN 'cams_report.csv' WHEN 1 THEN 'kfintech_report.csv' ELSE 'nse_report.csv' END AS file_name,
  'reports' AS file_id,
  c_custkey + 2 AS raw_row_index, concat('F', CAST(c_custkey AS STRING)) AS folio_number,
  CASE WHEN c_custkey % 13 = 0 THEN concat('ZZZZZ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'Z')
       WHEN c_custkey % 19 = 0 THEN concat('QQQQQ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'Q')
       ELSE pan END AS pan,
  CASE WHEN c_custkey % 11 = 0 THEN concat(investor_name, ' K') ELSE investor_name END AS investor_name,
  CASE WHEN c_custkey % 19 = 0 THEN '9000000001' ELSE mobile END AS mobile,
  CASE WHEN c_custkey % 19 = 0 THEN 'nobody@example.com' ELSE email END AS email,
  kyc_status, fatca_status,
  CASE WHEN c_custkey % 23 = 0 THEN 'INACTIVE' ELSE investor_status END AS investor_status,
  CAST(total_amount + CASE WHEN c_custkey % 7 = 0 THEN CAST(12.50 AS DECIMAL(18,2))
                           WHEN c_custkey % 7 = 1 THEN CAST(0.05 AS DECIMAL(18,2))
                           ELSE CAST(0 AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS total_amount,
  CASE WHEN c_custkey % 37 = 0 THEN TRUE ELSE FALSE END AS email_cell_blank
FROM (SELECT CAST(crm_client_id AS BIGINT) AS c_custkey, * FROM crm) t
WHERE c_custkey % 10 <> 9
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crm_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(CRM_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, folder, "customer"))


def report_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(REP_SQL.replace("FROM crm)", "FROM {crm})"), crm=crm_table(spark, folder))
