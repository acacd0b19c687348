"""The driver's tables as lead tables, in Spark and as SQL text.

Customers stand in for messy leads: every column is text, spelled in several ways by a
rule of the key. Orders stand in for bureau accounts and events for a funnel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Both engines read this.
_LEADS = """
  SELECT CAST(c_custkey AS {string}) AS lead_id,
    CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) || ' ' WHEN c_custkey % 11 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS source,
    CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '12345'
      ELSE '+91-' || CAST(7000000000 + c_custkey AS {string}) || CASE WHEN c_custkey % 3 = 0 THEN '.0' ELSE '' END END AS phone,
    CASE WHEN c_custkey % 23 = 0 THEN '  ' ELSE lpad(CAST(1 + c_custkey % 28 AS {string}), 2, '0') || '/' || lpad(CAST(1 + c_custkey % 5 AS {string}), 2, '0') || '/2024' END AS created_at,
    CASE c_custkey % 6 WHEN 0 THEN 'Roof; Cellar' WHEN 1 THEN 'Cellar;Roof' WHEN 2 THEN 'Porch' WHEN 3 THEN 'Yard; Roof' WHEN 4 THEN 'Porch; Cellar; Roof' ELSE NULL END AS areas,
    CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN '0' WHEN c_custkey % 29 = 0 THEN 'n/a'
      ELSE CAST(300 + c_custkey * 7919 % 550 AS {string}) END AS score,
    CASE WHEN c_custkey % 23 < 9 THEN 'Asked' WHEN c_custkey % 23 < 16 THEN 'Quoted' WHEN c_custkey % 23 < 20 THEN 'Surveyed'
      WHEN c_custkey % 23 = 20 THEN 'Signed' WHEN c_custkey % 46 = 21 THEN 'Moved away' ELSE NULL END AS disposition,
    CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey % 9 AS {string}) || 'yrs ' || CAST(c_custkey % 12 AS {string}) || 'mon' WHEN 1 THEN CAST(c_custkey % 30 AS {string}) || ' months'
      WHEN 2 THEN CAST(c_custkey % 4 AS {string}) || ' years' WHEN 3 THEN 'about 2 years' WHEN 4 THEN CAST(c_custkey % 7 AS {string}) ELSE '' END AS tenure,
    CAST(1000000 + c_custkey AS {string}) || '.0' AS external_id,
    'note ' || c_name || ' ' || CAST(c_custkey AS {string}) AS notes,
    CAST(c_acctbal AS {string}) AS balance,
    CAST(NULL AS {string}) AS empty
  FROM customer
"""

LEAD_COLUMNS = ("lead_id", "source", "phone", "created_at", "areas", "score", "disposition", "tenure", "external_id", "notes", "balance", "empty")

#: A CTE for DuckDB.
LEADS_SQL = "WITH leads AS (" + _LEADS.format(string="VARCHAR") + ")"


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LEADS.format(string="STRING").replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


#: (column, value, n) of all lead columns, for DuckDB.
VC_SQL = (
    LEADS_SQL
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM leads" for c in LEAD_COLUMNS)
    + "), vc AS (SELECT col, value, count(*) AS n FROM long GROUP BY 1, 2),"
    " solid AS (SELECT * FROM vc WHERE value IS NOT NULL AND NOT regexp_full_match(value, '\\s*'))"
)


#: Both engines read this: an earlier table of leads, which another one is held against.
_PAST = """
  SELECT CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'machinery ' WHEN 2 THEN 'FURNITURE' ELSE ' AUTOMOBILE' END AS source,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(300 + s_suppkey * 31 % 550 AS {string}) END AS score,
    CASE s_suppkey % 3 WHEN 0 THEN 'Roof; Cellar' WHEN 1 THEN 'Porch' ELSE NULL END AS areas,
    'note ' || s_name AS notes
  FROM supplier
"""
PAST_SQL = _PAST.format(string="VARCHAR")


def past_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAST.format(string="STRING").replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))


def funnel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as leads: event_type is the funnel's value."""
    return table(spark, sf_dir, "events")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, score): orders with a label and a tied score that leans on it."""
    o = table(spark, sf_dir, "orders")
    y = (F.col("o_orderstatus") == "F").cast("int")
    return o.select(F.col("o_orderkey").alias("row_id"), y.alias("y"), ((F.col("o_orderkey") * 7919 % 1000 + 200 * y) / 1200.0).alias("score"))


SCORED_SQL = """WITH scored AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
  (o_orderkey * 7919 % 1000 + 200 * CAST(o_orderstatus = 'F' AS INTEGER)) / 1200.0 AS score FROM orders)"""
