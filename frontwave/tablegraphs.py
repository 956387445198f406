"""Graphs derived from the driver's whole tables: users of successive events, suppliers and parts, orders and parts, customers and nations. The edge SQL is the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph
from .operators import ranges

EDGE_SQL = {
    "seq": "SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events) x WHERE dst IS NOT NULL",
    "supply": "SELECT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem",
    "op": "SELECT DISTINCT l_orderkey AS src, 10000000 + l_partkey AS dst FROM lineitem",
    "home": "SELECT c_custkey AS src, 10000000 + c_nationkey AS dst FROM customer",
}


def successive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of each event and that of the next one in event order, without one task that holds all events.

    Events are cut into ranges of their ids, whose number follows the events; each range gets a guest copy of the next range's first event.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    placed = events.withColumn("_range", ranges.number(F.col("event_id"), ranges.bounds(events, "event_id")))
    firsts = placed.groupBy("_range").agg(F.min_by("user_id", "event_id").alias("user_id"), F.min("event_id").alias("event_id"))
    guests = firsts.select("event_id", "user_id", F.lag("_range").over(Window.orderBy("_range")).alias("_range"), F.lit(True).alias("_guest")).where("_range is not null")
    order = Window.partitionBy("_range").orderBy("event_id")
    rows = placed.withColumn("_guest", F.lit(False)).unionByName(guests)
    return rows.withColumn("dst", F.lead("user_id").over(order)).where("not _guest and dst is not null").select(F.col("user_id").alias("src"), "dst")


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "seq":
        return successive(spark, sf_dir)
    if name == "home":
        return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS src", "10000000 + c_nationkey AS dst")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if name == "supply":
        return lines.selectExpr("l_suppkey AS src", "1000000 + l_partkey AS dst")
    if name == "op":
        return lines.selectExpr("l_orderkey AS src", "10000000 + l_partkey AS dst").distinct()
    raise ValueError(name)


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return Graph.of(edges(spark, sf_dir, name))
