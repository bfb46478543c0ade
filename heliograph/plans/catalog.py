"""The property graph over ordinary tables: labels, edge types and their schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import visible

MODES = ("strict", "validated", "flexible")


@dataclass
class NodeTable:
    label: str
    df: DataFrame  # id and properties
    mode: str = "flexible"
    temporal: bool = False
    versioned: bool = False  # rows carry created_at and deleted_at, their system time
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c != "id"]

    def rows(self) -> DataFrame:
        """The table with defaults in place of nulls, which are applied on read."""
        df = visible(self.df) if self.versioned else self.df
        return df.fillna(self.defaults) if self.defaults else df

    def violations(self) -> DataFrame:
        """property, rule, rows of every broken NOT NULL or UNIQUE rule; empty if none is."""
        spark, out = self.df.sparkSession, None
        for p in self.required:
            part = self.df.where(F.col(p).isNull()).agg(F.count("*").alias("rows")).select(F.lit(p).alias("property"), F.lit("not null").alias("rule"), "rows")
            out = part if out is None else out.union(part)
        for p in self.unique:
            dup = self.df.where(F.col(p).isNotNull()).groupBy(p).count().where("count > 1")
            part = dup.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit(p).alias("property"), F.lit("unique").alias("rule"), "rows")
            out = part if out is None else out.union(part)
        return out.where("rows > 0") if out is not None else spark.createDataFrame([], "property string, rule string, rows long")


@dataclass
class EdgeTable:
    type: str
    df: DataFrame  # src, dst and properties; valid_from and valid_to if temporal
    source: str | None = None
    target: str | None = None
    temporal: bool = False
    versioned: bool = False

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst")]

    def rows(self) -> DataFrame:
        return visible(self.df) if self.versioned else self.df


class GraphCatalog:
    """Registered labels and edge types; every query reads these DataFrames as they are."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.nodes: dict[str, NodeTable] = {}
        self.edges: dict[str, EdgeTable] = {}
        self.indexes: dict[str, dict] = {}
        self.triggers: dict[str, dict] = {}
        self.extensions: dict[str, object] = {}
        self.log: list[dict] = []  # queries with fingerprint and seconds, for the advisor
        self.dismissed: set[int] = set()  # fingerprints that the advisor leaves out

    def node(self, label: str, df: DataFrame, id: str = "id", **options) -> GraphCatalog:
        df = df.withColumnRenamed(id, "id") if id != "id" else df
        df = df.select(F.col("id").cast("long").alias("id"), *[c for c in df.columns if c != "id"])
        if options.get("mode", "flexible") not in MODES:
            raise ValueError(f"schema mode is one of {MODES}")
        self.nodes[label] = NodeTable(label, df, **options)
        return self

    def edge(self, type: str, df: DataFrame, src: str = "src", dst: str = "dst", source: str | None = None, target: str | None = None, temporal: bool = False, distinct: bool = False, versioned: bool = False) -> GraphCatalog:
        """distinct: df may name a pair twice, and adjacency is a set. Temporal types keep a row a version."""
        rest = [c for c in df.columns if c not in (src, dst)]
        df = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *rest)
        if temporal and not {"valid_from", "valid_to"} <= set(df.columns):
            raise ValueError("a temporal edge type has valid_from and valid_to")
        self.edges[type] = EdgeTable(type, df.dropDuplicates(["src", "dst"]) if distinct and not temporal else df, source, target, temporal, versioned)
        return self

    def scan(self, label: str | None) -> DataFrame:
        """Nodes with a label, or all with their label in `__label`; columns that a label lacks are null."""
        if label is not None:
            return self.nodes[label].rows().withColumn("__label", F.lit(label))
        out = None
        for t in self.nodes.values():
            part = t.rows().withColumn("__label", F.lit(t.label))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            return self.spark.createDataFrame([], "id long, __label string")
        return out

    def edges_of(self, types: list[str], direction: str) -> DataFrame:
        """src, dst, __type, __a, __b (the stored ends), __sl, __dl (the labels declared for src and dst) and properties, read in a direction: out, in or both.

        A self-loop appears once when read both ways.
        """
        out = None
        for t in types or [*self.edges]:
            ends = {"__sl": F.lit(self.edges[t].source).cast("string"), "__dl": F.lit(self.edges[t].target).cast("string")}
            e = self.edges[t].rows().withColumns({"__type": F.lit(t), "__a": F.col("src"), "__b": F.col("dst"), **ends})
            out = e if out is None else out.unionByName(e, allowMissingColumns=True)
        if out is None:
            return self.spark.createDataFrame([], "src long, dst long, __type string, __a long, __b long, __sl string, __dl string")
        swapped = out.withColumns({"src": F.col("__b"), "dst": F.col("__a"), "__sl": F.col("__dl"), "__dl": F.col("__sl")})
        if direction == "out":
            return out
        return swapped if direction == "in" else out.unionByName(swapped.where("__a <> __b"))

    def as_of(self, instant: Column) -> GraphCatalog:
        """Versioned tables as they were at an instant; others as they are."""
        out = self.copy()
        for tables in (out.nodes, out.edges):
            for name, t in tables.items():
                if t.versioned:
                    tables[name] = replace(t, df=visible(t.df, instant), versioned=False)
        return out

    def copy(self) -> GraphCatalog:
        """A catalogue with the same tables, which changes by itself; the log of queries is shared."""
        out = GraphCatalog(self.spark)
        for name in ("nodes", "edges", "indexes", "triggers", "extensions"):
            setattr(out, name, dict(getattr(self, name)))
        out.log, out.dismissed = self.log, self.dismissed
        return out
