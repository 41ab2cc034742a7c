"""Facts of the operators from the driver's tables, and the same facts as SQL.

The tables hold no source code, so the operators are bound to columns of the same
shape: an order is a commit, its parts are the files, its customer the author.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit, its distinct parts are files, its customer is the author."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("file")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.unix_timestamp("o_orderdate").alias("ts"))
    return lines.join(orders, "hash")


COMMIT_FILES = """
commit_files AS (
  SELECT DISTINCT l_orderkey AS hash, o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_partkey AS file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

PAIRS = (
    COMMIT_FILES
    + """,
sizes AS (SELECT hash, count(*) AS n FROM commit_files GROUP BY hash),
scoped AS (SELECT c.* FROM commit_files c JOIN sizes s ON c.hash = s.hash WHERE s.n <= 40),
revs AS (SELECT file, count(*) AS revisions FROM scoped GROUP BY file),
pairs AS (
  SELECT a.file AS file_a, b.file AS file_b, count(*) AS support, max(a.ts) AS last_seen, count(DISTINCT a.author) AS distinct_authors
  FROM scoped a JOIN scoped b ON a.hash = b.hash AND a.file < b.file GROUP BY ALL)"""
)


def nation_edges(spark: SparkSession, sf_dir: str, top: int = 2) -> DataFrame:
    """src, dst: each customer nation's `top` supplier nations by lines, itself left out."""
    from pyspark.sql import Window

    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    flow = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    flow = flow.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return flow.withColumn("r", rank).filter(F.col("r") <= top).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")


NATION_EDGES = """
flow AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS (
  SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM flow) WHERE r <= 2)"""
