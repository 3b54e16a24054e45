"""Stand-in citation data: an order cites the previous order (by date, then key) that holds the same part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.session import table


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citing, cited), once for each part that makes the two follow each other."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_orderdate")
    before = F.lag("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("o_orderdate", "l_orderkey"))
    # A part that an order holds twice follows itself, so no distinct is needed.
    return held.select(F.col("l_orderkey").alias("citing"), before.alias("cited")).where("cited is not null and citing <> cited")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citing, cited, weight)."""
    return graph_links(spark, sf_dir).groupBy("citing", "cited").agg(F.count(F.lit(1)).alias("weight"))


def graph_nodes(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """(id, docket_id, year, date, cited_all, cited_scotus, outdeg, is_real)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"))
    indeg = edges.groupBy(F.col("cited").alias("id")).agg(F.count(F.lit(1)).alias("indeg"))
    outdeg = edges.groupBy(F.col("citing").alias("id")).agg(F.count(F.lit(1)).alias("outdeg"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("docket_id"), F.year("o_orderdate").alias("year"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date"))
    rows = orders.join(lines, "id", "left").join(indeg, "id", "left").join(outdeg, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "id", "docket_id", "year", "date", zero("n_lines").alias("cited_all"), zero("indeg").alias("cited_scotus"), zero("outdeg").alias("outdeg"),
        (F.coalesce("n_lines", F.lit(0)) >= 3).alias("is_real"),
    )


def graph_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, year, name, cite) of orders: the name and the cite of their smallest part."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("p"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_size").alias("cite"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return orders.join(lines, "id").join(parts, "p").select("id", "year", "name", "cite")


#: The same in DuckDB's SQL; queries' SQL is prefixed by what it needs.
G_EDGES = """g_edges AS MATERIALIZED (
  SELECT citing, cited, count(*) AS weight FROM (
    SELECT k AS citing, lag(k) OVER (PARTITION BY p ORDER BY dt, k) AS cited FROM (
      SELECT DISTINCT l_orderkey AS k, l_partkey AS p, o_orderdate AS dt FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
  WHERE cited IS NOT NULL AND citing <> cited GROUP BY citing, cited)"""
G_NODES = """g_nodes AS MATERIALIZED (
  SELECT o_orderkey AS id, o_custkey AS docket_id, CAST(year(o_orderdate) AS INTEGER) AS year, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS date,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS cited_all, CAST(coalesce(indeg, 0) AS BIGINT) AS cited_scotus,
    CAST(coalesce(outdeg, 0) AS BIGINT) AS outdeg, coalesce(n_lines, 0) >= 3 AS is_real
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT cited, count(*) AS indeg FROM g_edges GROUP BY 1) i ON cited = o_orderkey
  LEFT JOIN (SELECT citing, count(*) AS outdeg FROM g_edges GROUP BY 1) o ON citing = o_orderkey)"""
G_META = """g_meta AS MATERIALIZED (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, p_name AS name, p_brand || ' ' || p_size AS cite
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = p)"""
