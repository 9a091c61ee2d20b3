"""The two views that queries over the driver's tables start from, in Spark and in SQL.

``px``: a raster. Each label of ``embeddings`` is an image, its vectors in order of id are the rows, and the elements
are the columns. ``cells``: facts. Each order is a cell with the dimensions and features of its customer and lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somatrix.tables import table

#: Foreground thresholds: sparse pixels for components, dense ones for erosion.
SPARSE, DENSE = 0.15, -0.3


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, r, c, v): every pixel with its value as a double."""
    rows = table(spark, sf_dir, "embeddings").withColumn("r", F.dense_rank().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return rows.select(F.col("label").alias("img"), "r", F.posexplode("embedding").alias("c", "v")).withColumn("v", F.col("v").cast("double"))


def foreground(spark: SparkSession, sf_dir: str, above: float) -> DataFrame:
    return px(spark, sf_dir).filter(F.col("v") > above).select("img", "r", "c")


PX_SQL = """
px_rows AS (SELECT label AS img, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding FROM embeddings),
px AS (SELECT img, r, i - 1 AS c, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT img, r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM px_rows)),
sparse AS (SELECT img, r, c FROM px WHERE v > 0.15),
dense AS (SELECT img, r, c FROM px WHERE v > -0.3)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: dimensions, ids, six features and a cluster from -1 (noise) to 5."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 2).alias("quantity"),
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("price"),
        F.max("l_discount").alias("discount"),
        F.max("l_tax").alias("tax"),
        F.max("l_linenumber").alias("lines"),
    )
    whole = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"])
    whole = whole.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"]).join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    return whole.select(
        F.col("o_orderkey").alias("cell"),
        F.col("c_custkey").cast("string").alias("subject"),
        F.col("c_mktsegment").alias("group"),
        F.col("o_orderstatus").alias("treatment"),
        F.col("o_orderpriority").alias("tissue"),
        F.col("r_name").alias("region"),
        "quantity",
        "price",
        "discount",
        "tax",
        F.col("o_totalprice").alias("total"),
        F.col("c_acctbal").alias("balance"),
        (F.pmod(F.col("o_orderkey"), F.lit(7)) - 1).cast("int").alias("cluster"),
    )


FEATURES = ("quantity", "price", "discount", "tax", "total", "balance")

CELLS_SQL = """
lines AS (SELECT l_orderkey, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS quantity,
  round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS price, max(l_discount) AS discount, max(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey),
cells AS (SELECT o_orderkey AS cell, CAST(c_custkey AS VARCHAR) AS subject, c_mktsegment AS "group", o_orderstatus AS treatment, o_orderpriority AS tissue, r_name AS region,
  quantity, price, discount, tax, o_totalprice AS total, c_acctbal AS balance, CAST(o_orderkey % 7 - 1 AS INTEGER) AS cluster
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
