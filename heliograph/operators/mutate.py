"""Writes as transforms: each takes node and edge tables and gives new ones.

Node tables have `id`; edges are given as {type: (DataFrame with src and dst, whether its
sources are nodes of the label, whether its targets are)}.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

Edges = dict[str, tuple[DataFrame, bool, bool]]


class WriteError(ValueError):
    pass


def with_ids(new: DataFrame, first: Column | int, order: list[str]) -> DataFrame:
    """Rows with consecutive ids from `first`, in the given order.

    Rows are sorted by range, numbered inside each partition, and set off by the counts of
    the partitions before: no task sees all rows. The ranges are kept, as both the numbers and
    the counts must see the same ones.
    """
    parts = cut(new.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    n = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    counts = parts.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.withColumn("__n", n).join(F.broadcast(before), "__p").withColumn("id", (F.lit(first) if isinstance(first, int) else first) + F.col("__n") + F.col("before") - 1).drop("__p", "__n", "before")


def next_id(nodes: DataFrame) -> int:
    return (nodes.agg(F.max("id")).first()[0] or 0) + 1


def create_nodes(nodes: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    return nodes.unionByName(with_ids(new, next_id(nodes), order), allowMissingColumns=True)


def create_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adjacency is a set: a pair that is there stays as it is."""
    fresh = new.dropDuplicates(["src", "dst"]).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.unionByName(fresh, allowMissingColumns=True)


def set_properties(nodes: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return nodes.withColumns({k: F.when(where, v).otherwise(F.col(k) if k in nodes.columns else F.lit(None)) for k, v in values.items()})


def remove_properties(nodes: DataFrame, where: Column, names: list[str]) -> DataFrame:
    return nodes.withColumns({k: F.when(~F.coalesce(where, F.lit(False)), F.col(k)) for k in names})


def delete_nodes(nodes: DataFrame, edges: Edges, ids: DataFrame, detach: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the nodes of `ids`; edges at either end go too, or without detach are an error."""
    gone, out = ids.select(F.col("id").alias("__x")).distinct(), {}
    for t, (e, source, target) in edges.items():
        left = e
        for end, is_label in (("src", source), ("dst", target)):
            if is_label:
                left = left.join(gone, left[end] == F.col("__x"), "left_anti")
        if not detach and left.count() != e.count():
            raise WriteError(f"nodes still have {t} edges")
        out[t] = left
    return nodes.join(gone, nodes["id"] == F.col("__x"), "left_anti"), out


def merge(nodes: DataFrame, wanted: DataFrame, keys: list[str], on_match: dict[str, Column] | None = None, on_create: dict[str, Column] | None = None) -> DataFrame:
    """Match or create: each distinct wanted row that no node equals on the keys becomes a node."""
    wanted = wanted.select(*keys).distinct()
    right = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [nodes[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    hit = nodes.join(right.withColumn("__hit", F.lit(True)), same, "left").drop(*[f"__{k}" for k in keys])
    hit = set_properties(hit, F.coalesce(F.col("__hit"), F.lit(False)), on_match or {}).drop("__hit")
    there = nodes.select(*[F.col(k).alias(f"__{k}") for k in keys])
    miss = wanted.join(there, [wanted[k].eqNullSafe(there[f"__{k}"]) for k in keys], "left_anti")
    miss = with_ids(miss, next_id(nodes), keys).withColumns(on_create or {})
    return hit.unionByName(miss, allowMissingColumns=True)


def upsert(nodes: DataFrame, where: Column, on_match: dict[str, Column], create: DataFrame, order: list[str]) -> DataFrame:
    """Update the matches, or create if there is none."""
    return set_properties(nodes, where, on_match) if not nodes.where(where).isEmpty() else create_nodes(nodes, create, order)


def _pairs_once(e: DataFrame, duplicates: str, first: Column | None = None) -> DataFrame:
    """One edge a pair: `merge` takes each property's first value, `keep target` those of edges that were there."""
    props = [c for c in e.columns if c not in ("src", "dst", "__moved")]
    order = F.struct("__moved", *[F.col(p).cast("string") for p in props])
    if duplicates == "both":
        return e.drop("__moved")
    if duplicates == "keep target":
        return e.groupBy("src", "dst").agg(*[F.min_by(p, order).alias(p) for p in props]) if props else e.select("src", "dst").distinct()
    if duplicates != "merge":
        raise WriteError(f"duplicates: both, merge or keep target, not {duplicates}")
    return e.groupBy("src", "dst").agg(*[F.min_by(p, F.when(F.col(p).isNotNull(), order)).alias(p) for p in props]) if props else e.select("src", "dst").distinct()


def merge_nodes(nodes: DataFrame, edges: Edges, into: dict[int, int], keep: str = "first", duplicates: str = "merge", values: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Nodes collapse into their targets with their edges.

    keep: first (the target's values), last (of the last merged node), coalesce (the first that is not null); values
    override. into: old id -> target id, a bounded list that a statement names.
    """
    spark = nodes.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(into.items()), "__old long, __new long"))
    props = [c for c in nodes.columns if c != "id"]
    mapped = nodes.join(table, nodes["id"] == F.col("__old"), "left").withColumn("__to", F.coalesce("__new", "id"))
    touched = F.col("__to").isin([*set(into.values())])
    rank = F.struct(F.col("__new").isNotNull(), F.col("id"))
    pick = {"first": lambda c: F.min_by(c, rank), "last": lambda c: F.max_by(c, rank), "coalesce": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank))}[keep]
    merged = mapped.where(touched).groupBy(F.col("__to").alias("id")).agg(*[pick(c).alias(c) for c in props])
    out_nodes = mapped.where(~touched).select("id", *props).unionByName(merged.withColumns(values or {}).select("id", *props))
    out = {}
    for t, (e, source, target) in edges.items():
        moved = e.withColumn("__moved", F.lit(False))
        for end, is_label in (("src", source), ("dst", target)):
            if is_label:
                moved = moved.join(table, moved[end] == F.col("__old"), "left").withColumn("__moved", F.col("__moved") | F.col("__new").isNotNull()).withColumn(end, F.coalesce("__new", end)).drop("__old", "__new")
        out[t] = _pairs_once(moved, duplicates)
    return out_nodes, out


def clone_nodes(nodes: DataFrame, edges: Edges, ids: list[int], values: dict[str, Column] | None = None, with_edges: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Copies of the named nodes under new ids, optionally with copies of their edges."""
    first = next_id(nodes)
    new = {old: first + i for i, old in enumerate(sorted(set(ids)))}
    table = F.broadcast(nodes.sparkSession.createDataFrame([*new.items()], "__old long, __new long"))
    copies = nodes.join(table, nodes["id"] == F.col("__old")).withColumn("id", F.col("__new")).drop("__old", "__new").withColumns(values or {})
    out = {}
    for t, (e, source, target) in edges.items():
        out[t] = e
        for end, is_label in (("src", source), ("dst", target)):
            if with_edges and is_label:
                out[t] = out[t].unionByName(e.join(table, e[end] == F.col("__old")).withColumn(end, F.col("__new")).drop("__old", "__new"))
    return nodes.unionByName(copies), out


def redirect_edges(edges: DataFrame, old: int, new: int, direction: str = "both") -> DataFrame:
    """Edges of one node moved to another; pairs stay distinct."""
    out = edges
    for end, ways in (("src", ("out", "both")), ("dst", ("in", "both"))):
        if direction in ways:
            out = out.withColumn(end, F.when(F.col(end) == old, F.lit(new).cast("long")).otherwise(F.col(end)))
    return out.dropDuplicates(["src", "dst"])


def has_type(property: str) -> str:
    """Default edge type for a detached document."""
    out = "".join("_" + c if c.isupper() and i and not property[i - 1].isupper() else c for i, c in enumerate(property))
    return "HAS_" + out.upper().replace("-", "_").replace(" ", "_")


def detach_document(nodes: DataFrame, property: str, first_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes without the property, its documents as nodes, edges to them)."""
    full = nodes.where(F.col(property).isNotNull()).select(F.col("id").alias("__src"), property)
    docs = with_ids(full, next_id(nodes) if first_id is None else first_id, ["__src"])
    return nodes.drop(property), docs.select("id", f"{property}.*"), docs.select(F.col("__src").alias("src"), F.col("id").alias("dst"))


def attach_document(nodes: DataFrame, docs: DataFrame, edges: DataFrame, property: str) -> DataFrame:
    """nodes with the node at the end of each edge nested as a struct; several are an error."""
    if not edges.groupBy("src").count().where("count > 1").isEmpty():
        raise WriteError("a node has more than one document to attach")
    nested = docs.select(F.col("id").alias("__d"), F.struct(*[c for c in docs.columns if c != "id"]).alias(property))
    linked = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__t")).join(nested, F.col("__t") == F.col("__d")).drop("__t", "__d")
    return nodes.join(linked, nodes["id"] == F.col("__s"), "left").drop("__s")


def doc_push(items: Column, value: Column) -> Column:
    return F.array_append(F.coalesce(items, F.array().cast("array<bigint>")), value)


def doc_pull(items: Column, value: Column) -> Column:
    """Without all that equal the value."""
    return F.array_remove(items, value)


def doc_add_to_set(items: Column, value: Column) -> Column:
    return F.when(F.array_contains(items, value), items).otherwise(doc_push(items, value))


def doc_inc(number: Column, by: Column) -> Column:
    return F.coalesce(number, F.lit(0)) + by


def foreach(rows: DataFrame, items: Column, variable: str, write):
    """write(rows of all elements), once for the whole set, and the rows passed through."""
    return rows, write(rows.withColumn(variable, F.explode(items)))


def token_of(text: Column, key: bytes | str) -> Column:
    """Keyed token of a text, for equality on encrypted values: HMAC with SHA-256, from Spark's own hash.

    The key is padded to the hash's block and mixed with two constants; each gives one pass of the hash.
    """
    key = key.encode() if isinstance(key, str) else bytes(key)
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256))


def encrypted_equal(rows: DataFrame, column: str, value: str, key: bytes) -> DataFrame:
    wanted = hmac.new(key, value.encode(), hashlib.sha256).digest()
    return rows.where(token_of(F.col(column), key) == F.lit(wanted))
