"""Dump and restore: node and edge JSON lines, and a query script; benchmark vector files."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.catalog import GraphCatalog


def export_json(catalog: GraphCatalog, path: str) -> None:
    """`path`/nodes and `path`/edges: a JSON object a line, with label or type and properties."""
    for label, t in catalog.nodes.items():
        t.df.select(F.lit("node").alias("kind"), F.lit(label).alias("label"), "id", F.struct(*t.properties).alias("properties") if t.properties else F.struct(F.lit(None).cast("string").alias("none")).alias("properties")).write.mode("append").json(f"{path}/nodes/{label}")
    for kind, e in catalog.edges.items():
        props = F.struct(*e.properties) if e.properties else F.struct(F.lit(None).cast("string").alias("none"))
        e.df.select(F.lit("edge").alias("kind"), F.lit(kind).alias("type"), F.lit(e.source).alias("source_label"), F.lit(e.target).alias("target_label"), "src", "dst", props.alias("properties")).write.mode("append").json(f"{path}/edges/{kind}")


def restore_json(spark: SparkSession, path: str, labels: dict[str, T.StructType], types: dict[str, T.StructType | None]) -> GraphCatalog:
    """The catalogue of a dump. labels, types: the properties' schemas, so that no file is read to infer them."""
    g = GraphCatalog(spark)
    for label, props in labels.items():
        df = spark.read.schema(T.StructType([T.StructField("id", T.LongType()), T.StructField("properties", props)])).json(f"{path}/nodes/{label}")
        g.node(label, df.select("id", "properties.*"))
    for kind, props in types.items():
        fields = [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("source_label", T.StringType()), T.StructField("target_label", T.StringType())]
        df = spark.read.schema(T.StructType([*fields, *([T.StructField("properties", props)] if props else [])])).json(f"{path}/edges/{kind}")
        ends = df.select("source_label", "target_label").first()
        g.edge(kind, df.select("src", "dst", *(["properties.*"] if props else [])), source=ends[0] if ends else None, target=ends[1] if ends else None)
    return g


def _literal(c: str, t: T.DataType) -> Column:
    text = F.col(f"`{c}`").cast("string")
    if isinstance(t, T.StringType):
        text = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), text))


def script(catalog: GraphCatalog) -> DataFrame:
    """statement: one that creates each node, then one that creates each edge; `ord` puts nodes first."""
    out = None
    for label, t in catalog.nodes.items():
        plain = [(f.name, f.dataType) for f in t.df.schema if f.name != "id" and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))]
        body = F.concat_ws(", ", F.concat(F.lit("id: "), F.col("id")), *[_literal(*p) for p in plain])
        part = t.df.select(F.lit(0).alias("ord"), F.concat(F.lit(f"CREATE (:{label} {{"), body, F.lit("})")).alias("statement"))
        out = part if out is None else out.union(part)
    for kind, e in catalog.edges.items():
        a, b = (f":{x}" if x else "" for x in (e.source, e.target))
        text = F.concat(F.lit(f"MATCH (a{a} {{id: "), "src", F.lit(f"}}), (b{b} {{id: "), "dst", F.lit(f"}}) CREATE (a)-[:{kind}]->(b)"))
        part = e.df.select(F.lit(1).alias("ord"), text.alias("statement"))
        out = part if out is None else out.union(part)
    return out


def read_fvecs(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """id, embedding of a file of little-endian float vectors, each led by its length."""
    width = 4 * (dimensions + 1)
    raw = spark.read.format("binaryFile").load(path).select("content")
    n = F.floor(F.octet_length("content") / width).cast("int")
    rows = raw.select("content", F.explode(F.sequence(F.lit(0), n - 1)).alias("id")).select(F.col("id").cast("long").alias("id"), F.substring("content", F.col("id") * width + 5, F.lit(4 * dimensions)).alias("raw"))

    @F.pandas_udf("array<float>")
    def floats(raw):
        import numpy as np

        return raw.map(lambda b: np.frombuffer(b, "<f4"))

    return rows.select("id", floats("raw").alias("embedding"))
