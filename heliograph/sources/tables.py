"""The property graph over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.catalog import GraphCatalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Region, Nation, Customer, Supplier, Part, Order, Document, Vec, User, EventType and their edges.

    Nothing is read until a query needs it.
    """
    t = {name: read(spark, sf_dir, name) for name in TABLES}
    g = GraphCatalog(spark)
    g.node("Region", t["region"], "r_regionkey").node("Nation", t["nation"], "n_nationkey")
    g.node("Customer", t["customer"], "c_custkey").node("Supplier", t["supplier"], "s_suppkey")
    g.node("Part", t["part"], "p_partkey").node("Order", t["orders"], "o_orderkey")
    g.node("Document", t["documents"], "doc_id").node("Vec", t["embeddings"], "vec_id")
    g.edge("IN_REGION", t["nation"].select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "Nation", "Region")
    g.edge("IN_NATION", t["customer"].select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "Customer", "Nation")
    g.edge("BASED_IN", t["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "Supplier", "Nation")
    g.edge("PLACED", t["orders"].select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "Customer", "Order")
    line = t["lineitem"]
    per_pair = line.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    g.edge("CONTAINS", per_pair, "l_orderkey", "l_partkey", "Order", "Part")
    g.edge("SUPPLIES", line.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", "Supplier", "Part", distinct=True)
    # A tree over parts: each part under the part of half its key.
    g.edge("PARENT", t["part"].where("p_partkey > 1").select("p_partkey", F.expr("p_partkey div 2").alias("up")), "p_partkey", "up", "Part", "Part")
    chunk = t["embeddings"].select((F.col("vec_id") % 50).alias("d"), "vec_id")
    g.edge("HAS_CHUNK", chunk, "d", "vec_id", "Document", "Vec")
    ev = t["events"].withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    users = ev.groupBy("user_id").agg(F.count("*").alias("events"))
    g.node("User", users, "user_id")
    g.node("EventType", t["events"].select("event_type").distinct().select(F.pmod(F.crc32(F.encode("event_type", "UTF-8")), F.lit(1 << 31)).alias("id"), F.col("event_type").alias("name")))
    after = F.lead("ms").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    did = ev.select("user_id", F.pmod(F.crc32(F.encode("event_type", "UTF-8")), F.lit(1 << 31)).alias("kind"), F.col("ms").alias("valid_from"), after.alias("valid_to"), "value")
    g.edge("DID", did, "user_id", "kind", "User", "EventType", temporal=True)
    return g
