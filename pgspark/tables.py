"""The graph, series, vectors and texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgspark.graph import EdgeTable, Graph, NodeTable
from pgspark.plans.rounds import dealt
from pgspark.plans.timeseries import as_samples

#: What is added to keys so that the nodes of one graph differ.
NATIONS, CUSTOMERS, SUPPLIERS, ORDERS = 100, 1_000, 10_000_000_000, 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes region, nation, customer, supplier, part, orders; edges by foreign keys, line items as edges with properties.

    A line item's key is a hash of all its columns: (order, line number) is not
    unique, and parallel edges stay.
    """
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem")
    lines = lines.withColumn("line_id", F.xxhash64(*lines.columns))
    nodes = {
        "region": NodeTable(t("region"), "r_regionkey", ("place",)),
        "nation": NodeTable(t("nation"), "n_nationkey", ("place",)),
        "customer": NodeTable(t("customer"), "c_custkey", ("party",)),
        "supplier": NodeTable(t("supplier"), "s_suppkey", ("party",)),
        "part": NodeTable(t("part"), "p_partkey"),
        "orders": NodeTable(t("orders"), "o_orderkey"),
    }
    edges = {
        "in_region": EdgeTable(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "nation", "region"),
        "customer_in": EdgeTable(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "customer", "nation"),
        "supplier_in": EdgeTable(t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "supplier", "nation"),
        "placed": EdgeTable(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "customer", "orders"),
        "contains": EdgeTable(lines, "l_orderkey", "l_partkey", "orders", "part", "line_id"),
        "supplied_by": EdgeTable(lines, "l_orderkey", "l_suppkey", "orders", "supplier", "line_id"),
    }
    return Graph(nodes, edges)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as series: one per user and event type."""
    return as_samples(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("value"))


def sells_with(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): part -> supplier links of all line items; suppliers' ids are moved past the parts' by an offset."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst"))
    edges = dealt(lines, lines.count(), "src", "dst").distinct()
    return ends(edges), edges


def ends(edges: DataFrame) -> DataFrame:
    """(id): the nodes that edges touch."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): customer -> order links; orders' ids are moved past the customers'."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = c.select(F.col("c_custkey").alias("id")).unionAll(o.select(F.col("o_orderkey") + ORDERS))
    return nodes, o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + ORDERS).alias("dst"), "o_orderstatus")


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges region -> nation -> customer -> order, each kind of node moved past the one before."""
    t = lambda name: table(spark, sf_dir, name)
    link = lambda df, src, dst, weight: df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), weight.cast("double").alias("weight"))
    c = F.col
    nations = link(t("nation"), c("n_regionkey"), c("n_nationkey") + NATIONS, 1 + c("n_nationkey") % 4)
    customers = link(t("customer"), c("c_nationkey") + NATIONS, c("c_custkey") + CUSTOMERS, 1 + c("c_custkey") % 5)
    orders = link(t("orders"), c("o_custkey") + CUSTOMERS, c("o_orderkey") + ORDERS, 1 + c("o_orderkey") % 3)
    return nations.unionAll(customers).unionAll(orders)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges order - part, order - supplier and part - supplier of all line items, as often as they occur."""
    o, p, s = F.col("l_orderkey") + ORDERS, F.col("l_partkey"), F.col("l_suppkey") + SUPPLIERS
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array(pair(o, p), pair(o, s), pair(p, s))).alias("e")).select("e.src", "e.dst")
