"""Statements about the catalogue: indexes, types, schema modes and triggers.

An index is a note in the catalogue: Spark reads tables by partition and row-group statistics, so what an
index name promises is that its property is looked up by value (the advisor then asks for no
other), and, if it is unique, a rule that writes check.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cypher.parser import Command, CypherError
from .catalog import MODES, EdgeTable, GraphCatalog, NodeTable

TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp", "blob": "binary", "binary": "binary", "map": "map<string,string>", "geo": "struct<latitude:double,longitude:double>", "document": "string"}


def execute(catalog: GraphCatalog, c: Command) -> DataFrame:
    """Changes the catalogue; the rows say what there is now."""
    rows, schema = globals()["do_" + c.kind](catalog, c.parts)
    return catalog.spark.createDataFrame(rows, schema)


def do_show(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    if p["what"] == "triggers":
        rows = [(n, t["on"], "|".join(t["events"]), t["timing"], t["enabled"], t["body"], t["on_error"]["then"]) for n, t in sorted(catalog.triggers.items())]
        return rows, "name string, target string, events string, timing string, enabled boolean, body string, on_error string"
    if p["what"] == "sessions":  # one Spark session, and nothing that is open between statements
        return [(catalog.spark.sparkContext.applicationId,)], "session string"
    return [], "transaction string, session string"


def do_alter_label(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    if p["mode"] not in MODES:
        raise CypherError(f"schema mode is one of {MODES}")
    table = _label(catalog, p["label"])
    catalog.nodes[p["label"]] = replace(table, mode=p["mode"])
    return [(p["label"], p["mode"])], "label string, mode string"


def _label(catalog: GraphCatalog, label: str) -> NodeTable:
    if label not in catalog.nodes:
        raise CypherError(f"there is no label {label}")
    return catalog.nodes[label]


def do_create_index(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    if any(i["name"] == p["name"] for i in catalog.indexes.values()):
        raise CypherError(f"index {p['name']} is there already")
    if p["unique"]:
        table = _label(catalog, p["label"])
        with_rule = replace(table, unique=tuple(dict.fromkeys([*table.unique, p["property"]])))
        if p["property"] in table.df.columns and not with_rule.violations().where(F.col("property") == p["property"]).where("rule = 'unique'").isEmpty():
            raise CypherError(f"{p['label']}.{p['property']} has repeated values")
        catalog.nodes[p["label"]] = with_rule
    for prop in [p["property"]] if p["property"] else p["fields"]:
        catalog.indexes[f"{p['label']}.{prop}" + ("" if p["kind"] == "btree" else f"/{p['kind']}")] = p | {"property": prop}
    return [(p["name"], p["kind"], p["label"])], "name string, kind string, label string"


def do_drop_index(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    keys = [k for k, i in catalog.indexes.items() if i["name"] == p["name"] and i["kind"] == p["kind"]]
    if not keys:
        raise CypherError(f"there is no {p['kind']} index {p['name']}")
    for k in keys:
        i = catalog.indexes.pop(k)
        if i["unique"] and i["label"] in catalog.nodes:
            table = catalog.nodes[i["label"]]
            catalog.nodes[i["label"]] = replace(table, unique=tuple(u for u in table.unique if u != i["property"]))
    return [(p["name"],)], "dropped string"


def _declared(catalog: GraphCatalog, p: dict, key: str, temporal: str) -> DataFrame:
    columns = [key] + [f"`{n}` {TYPES[t]}" for n, t, _ in p["properties"] if t in TYPES]
    if len(columns) <= len(p["properties"]):
        raise CypherError(f"types are {sorted(TYPES)}")
    names = {n for n, _, _ in p["properties"]}
    if p["temporal"]:
        columns += [f"{n} {temporal}" for n in ("valid_from", "valid_to") if n not in names]
    return catalog.spark.createDataFrame([], ", ".join(columns))


def do_create_node_type(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    table = catalog.nodes.get(p["name"])
    if table is not None and table.temporal != p["temporal"]:
        raise CypherError(f"{p['name']} cannot change whether it is temporal")
    required = tuple(n for n, _, r in p["properties"] if r)
    df = _declared(catalog, p, "id bigint", "bigint")
    if table is None:
        catalog.nodes[p["name"]] = NodeTable(p["name"], df, mode="validated", temporal=p["temporal"], required=required)
    else:
        catalog.nodes[p["name"]] = replace(table, df=table.df.unionByName(df, allowMissingColumns=True), required=required)
    return [(p["name"], p["temporal"])], "label string, temporal boolean"


def do_create_edge_type(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    table = catalog.edges.get(p["name"])
    if table is not None and table.temporal != p["temporal"]:
        raise CypherError(f"{p['name']} cannot change whether it is temporal")
    df = _declared(catalog, p, "src bigint, dst bigint", "bigint")
    catalog.edges[p["name"]] = EdgeTable(p["name"], df, temporal=p["temporal"]) if table is None else replace(table, df=table.df.unionByName(df, allowMissingColumns=True))
    return [(p["name"], p["temporal"])], "type string, temporal boolean"


def do_create_trigger(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    if p["name"] in catalog.triggers:
        raise CypherError(f"trigger {p['name']} is there already")
    catalog.triggers[p["name"]] = p
    return [(p["name"],)], "trigger string"


def _trigger(catalog: GraphCatalog, name: str) -> dict:
    if name not in catalog.triggers:
        raise CypherError(f"there is no trigger {name}")
    return catalog.triggers[name]


def do_drop_trigger(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    _trigger(catalog, p["name"])
    del catalog.triggers[p["name"]]
    return [(p["name"],)], "dropped string"


def do_alter_trigger(catalog: GraphCatalog, p: dict) -> tuple[list, str]:
    catalog.triggers[p["name"]] = _trigger(catalog, p["name"]) | p
    return [(p["name"],)], "trigger string"
