"""Procurement entities over the driver's tables: tenders, awards, bodies, companies.

Orders are tenders, customers bodies, line items awards of one lot, suppliers companies; nations
and regions are provinces and regions. Dimension tables are joined without hints: Spark
broadcasts them while their measured size is below its threshold and shuffles them beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("province"), F.col("r_name").alias("region"))


def tenders(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """id, body_id, body, segment, status, kind, amount, published, province, region, tags; or the wanted ones of them.

    Only the tables that wanted columns come from are joined: every tender has a body and every body a place,
    so leaving out a join keeps all rows, which the optimizer can't know.
    """
    columns = {
        "id": F.col("o_orderkey"), "body_id": F.col("o_custkey"), "body": F.col("c_name"), "segment": F.col("c_mktsegment"), "status": F.col("o_orderstatus"), "kind": F.col("o_orderpriority"),
        "amount": F.col("o_totalprice"), "published": F.col("o_orderdate"), "province": F.col("province"), "region": F.col("region"), "tags": F.array("c_mktsegment", F.split("o_orderpriority", "-")[1]),
    }
    names = wanted or tuple(columns)
    rows = table(spark, sf_dir, "orders")
    if {"body", "segment", "province", "region", "tags"} & set(names):
        body = table(spark, sf_dir, "customer")
        if {"province", "region"} & set(names):
            body = body.join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        rows = rows.join(body, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(*[columns[n].alias(n) for n in names])


def awards(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """tender_id, lot, company_id, company, budget, awarded, bids, awarded_on, part_id, cpv, brand; or the wanted ones of them, as in ``tenders``."""
    columns = {
        "tender_id": F.col("l_orderkey"), "lot": F.col("l_linenumber"), "company_id": F.col("l_suppkey"), "company": F.col("s_name"), "budget": F.col("l_extendedprice"),
        "awarded": F.col("l_extendedprice") * (1 - F.col("l_discount")), "bids": F.col("l_quantity").cast("int"), "awarded_on": F.col("l_shipdate"), "part_id": F.col("l_partkey"),
        "cpv": F.col("p_type"), "brand": F.col("p_brand"),
    }
    names = wanted or tuple(columns)
    rows = table(spark, sf_dir, "lineitem")
    if {"cpv", "brand"} & set(names):
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "company" in names:
        rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(*[columns[n].alias(n) for n in names])


#: The same entities for DuckDB.
TENDERS_SQL = """t AS (
  SELECT o_orderkey AS id, o_custkey AS body_id, c_name AS body, c_mktsegment AS segment, o_orderstatus AS status, o_orderpriority AS kind,
    o_totalprice AS amount, o_orderdate AS published, n_name AS province, r_name AS region, [c_mktsegment, split_part(o_orderpriority, '-', 2)] AS tags
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
AWARDS_SQL = """a AS (
  SELECT l_orderkey AS tender_id, l_linenumber AS lot, l_suppkey AS company_id, s_name AS company, l_extendedprice AS budget,
    l_extendedprice * (1 - l_discount) AS awarded, CAST(l_quantity AS INT) AS bids, l_shipdate AS awarded_on, l_partkey AS part_id,
    p_type AS cpv, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""
