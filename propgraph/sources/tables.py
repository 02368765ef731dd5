"""Graphs derived from order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customer_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Next customer: the customer of order k points to that of order k + 1, weighted by the price of k."""
    o = table(spark, folder, "orders")
    a = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("src"), F.col("o_totalprice").alias("w"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    b = o.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_custkey").alias("tgt"))
    return a.join(b, "k").select("k", "src", "tgt", "w", "priority", "status")


def customer_nodes(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, as src < tgt."""
    return edges.filter("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()


def forward_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges to larger ids: without cycles."""
    return edges.filter("src < tgt").select("src", "tgt").distinct()


def order_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Customers, nations, regions, orders, parts and suppliers with their relations."""
    t = lambda name: table(spark, folder, name)
    g = PropertyGraph(spark)
    g.add_domain("customer", customer_nodes(spark, folder), "string")
    g.add_domain("nation", t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("key")), "string")
    g.add_domain("region", t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("key")), "string")
    g.add_domain("order", t("orders").select(F.col("o_orderkey").alias("id")))
    g.add_domain("part", t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    g.add_domain("supplier", t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("key")), "string")
    g.add_relation("next_customer", "customer", "customer", customer_edges(spark, folder))
    g.add_relation("in_nation", "customer", "nation", t("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("tgt")))
    g.add_relation("in_region", "nation", "region", t("nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("tgt")))
    g.add_relation("ordered_by", "order", "customer", t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("tgt"), F.col("o_totalprice").alias("price")))
    g.add_relation("supplied_by", "part", "supplier", t("lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_linenumber").alias("line"),
    ))
    return g
