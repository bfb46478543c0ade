"""Expansion along edges: one hop, many hops, shortest paths.

Edges come as src, dst, __type, __a, __b (the stored ends), __sl, __dl (the labels declared for src
and dst, or null) and properties, already read in the wanted direction. Ids are of a label, so the
node that a walk has reached is its id with its label; '' stands for a label that nothing declares and
goes with any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import FEW, counted, side
from ..plans.lineage import cut

MAX_HOPS = 10
RELS = "array<struct<type:string,source:bigint,target:bigint>>"


def edge_key() -> Column:
    """Identity of a stored edge, the same in both directions. Adjacency is a set, so type and ends name an edge."""
    return F.xxhash64("__type", "__a", "__b")


def label_of(rows: DataFrame, var: str) -> Column:
    has = f"{var}____label"
    return F.coalesce(F.col(has), F.lit("")) if has in rows.columns else F.lit("")


def _declared(edges: DataFrame, end: str) -> Column:
    return F.coalesce(F.col(end), F.lit("")) if end in edges.columns else F.lit("")


def _agree(a: Column, b: Column) -> Column:
    return (a == b) | (a == "") | (b == "")


def _sides(left: DataFrame, right: DataFrame, few_left: bool, few_right: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join, the left one copied to all executors if only it has few rows."""
    return (side(left, True), right) if few_left and not few_right else (left, side(right, few_right))


def _step(rows: DataFrame, edges: DataFrame, few: bool, few_rows: bool = False) -> DataFrame:
    """Each row with the edges that leave its __cur of label __curl: to __d of label __dl, by __k and __r. few: of edges; few_rows: of rows."""
    rel = F.struct(F.col("__type").alias("type"), F.col("__a").alias("source"), F.col("__b").alias("target"))
    e = edges.select(F.col("src").alias("__s"), _declared(edges, "__sl").alias("__from_label"), F.col("dst").alias("__d"), _declared(edges, "__dl").alias("__dl"), edge_key().alias("__k"), rel.alias("__r"))
    rows, e = _sides(rows, e, few_rows, few)
    return rows.join(e, (rows["__cur"] == e["__s"]) & _agree(rows["__curl"], e["__from_label"])).drop("__s", "__from_label")


def var_length(rows: DataFrame, start: str, edges: DataFrame, low: int, high: int, target: str, path: str | None = None, distinct: bool = False, rels: str | None = None) -> DataFrame:
    """rows with the node at the end of each trail of low to high edges in `target`, and its label, or null, in __dl.

    A trail uses no edge twice, so cycles end. distinct: each target once for a row, by
    frontiers without trails; then rows must differ in `start`. rels: a column for the trail's edges.
    """
    high = min(high, MAX_HOPS)
    if distinct and path is None and rels is None and low <= 1:
        return _reachable(rows, start, edges, low, high, target)
    state = rows.withColumns({"__cur": F.col(start), "__curl": label_of(rows, start), "__trail": F.array().cast("array<bigint>"), "__nodes": F.array(F.col(start)), "__rels": F.array().cast(RELS)})
    found = [state] if low == 0 else []
    few = counted(edges) <= FEW
    for hop in range(1, high + 1):
        state = _step(state, edges, few).where(~F.array_contains("__trail", F.col("__k")))
        state = state.withColumns({"__cur": F.col("__d"), "__curl": F.col("__dl"), "__trail": F.array_append("__trail", F.col("__k")), "__nodes": F.array_append("__nodes", F.col("__d")), "__rels": F.array_append("__rels", F.col("__r"))}).drop("__d", "__dl", "__k", "__r")
        if high > 3:  # the next level and the result both read this one
            state = cut(state)
            if state.isEmpty():
                break
        if hop >= low:
            found.append(state)
    out = found[0] if found else state.where(F.lit(False))
    for part in found[1:]:
        out = out.unionByName(part)
    out = out.withColumn(target, F.col("__cur")).withColumn("__dl", F.nullif("__curl", F.lit("")))
    if path:
        out = out.withColumn(path, F.struct(F.col("__nodes").alias("nodes"), F.col("__rels").alias("rels")))
    if rels:
        out = out.withColumn(rels, F.col("__rels"))
    out = out.drop("__cur", "__curl", "__trail", "__nodes", "__rels")
    return out.distinct() if distinct else out


def _reachable(rows: DataFrame, start: str, edges: DataFrame, low: int, high: int, target: str) -> DataFrame:
    keys = ["__from", "__fl", "__cur", "__curl"]
    seeds = cut(rows.select(F.col(start).alias("__from"), label_of(rows, start).alias("__fl")).distinct())
    pairs = edges.select("src", "dst", _declared(edges, "__sl").alias("__sl"), _declared(edges, "__dl").alias("__to_label")).distinct()
    few = counted(edges) <= FEW
    front = seeds.withColumns({"__cur": F.col("__from"), "__curl": F.col("__fl")})
    seen = front.withColumn("__hop", F.lit(0))
    size = visited = counted(seeds)
    # The start itself counts as reached again only by a cycle, which the first visit must not hide.
    back = None
    for hop in range(1, high + 1):
        at, to = _sides(front, pairs, size <= FEW, few)
        step = at.join(to, (at["__cur"] == to["src"]) & _agree(at["__curl"], to["__sl"])).select("__from", "__fl", F.col("dst").alias("__cur"), F.col("__to_label").alias("__curl")).distinct()
        closed = step.where((F.col("__from") == F.col("__cur")) & _agree(F.col("__fl"), F.col("__curl")))
        back = closed if back is None else back.union(closed)
        front = cut(step.join(side(seen, visited <= FEW), keys, "left_anti"))
        size = counted(front)
        if not size:
            break
        seen, visited = seen.unionByName(front.withColumn("__hop", F.lit(hop))), visited + size
    reached = seen.where(F.col("__hop") >= low).select(keys)
    if low > 0 and back is not None:
        reached = reached.union(back).distinct()
    ends = reached.select("__from", "__fl", F.col("__cur").alias(target), F.nullif("__curl", F.lit("")).alias("__dl"))
    ends = side(ends, visited <= FEW)  # those come back to are no more than the starts
    named = rows.withColumn("__start_label", label_of(rows, start))
    return named.join(ends, (named[start] == ends["__from"]) & (named["__start_label"] == ends["__fl"])).drop("__from", "__fl", "__start_label")


def shortest_path(rows: DataFrame, start: str, end: str, edges: DataFrame, path: str, high: int = MAX_HOPS) -> DataFrame:
    """rows with one shortest path from start to end in `path`; NULL if there is none within `high` edges.

    Breadth first, level by level, for all distinct pairs at once; a start keeps one
    path to each node, and stops when its ends are reached.
    """
    ends = ["__from", "__fl", "__end", "__el"]
    named = rows.withColumns({"__rfl": label_of(rows, start), "__rel": label_of(rows, end)})
    pairs = cut(named.select(F.col(start).alias("__from"), F.col("__rfl").alias("__fl"), F.col(end).alias("__end"), F.col("__rel").alias("__el")).where("__from is not null and __end is not null").distinct())
    size = visited = counted(pairs)
    few, few_pairs = counted(edges) <= FEW, size <= FEW
    front = pairs.select("__from", "__fl").distinct().withColumns({"__cur": F.col("__from"), "__curl": F.col("__fl"), "__nodes": F.array("__from"), "__rels": F.array().cast(RELS)})
    seen = front.select("__from", "__fl", "__cur", "__curl")
    wanted = side(pairs.select(F.col("__from").alias("__f"), F.col("__fl").alias("__g"), "__end", "__el"), few_pairs)

    def hit(f: DataFrame) -> DataFrame:
        met = f.join(wanted, (F.col("__from") == F.col("__f")) & (F.col("__fl") == F.col("__g")) & (F.col("__cur") == F.col("__end")) & _agree(F.col("__curl"), F.col("__el")))
        x = F.struct(F.col("__nodes").alias("nodes"), F.col("__rels").alias("rels"))
        return met.groupBy(ends).agg(F.min(x).alias(path))

    found = cut(hit(front))
    for _ in range(min(high, MAX_HOPS)):
        left = pairs.join(side(found, few_pairs), ends, "left_anti").select("__from", "__fl").distinct()
        step = _step(front.join(side(left, few_pairs), ["__from", "__fl"], "left_semi"), edges, few, size <= FEW)
        step = step.select("__from", "__fl", F.col("__d").alias("__cur"), F.col("__dl").alias("__curl"), F.array_append("__nodes", F.col("__d")).alias("__nodes"), F.array_append("__rels", F.col("__r")).alias("__rels"))
        keys = ["__from", "__fl", "__cur", "__curl"]
        step = step.join(side(seen, visited <= FEW), keys, "left_anti")
        front = cut(step.groupBy(keys).agg(F.min(F.struct("__nodes", "__rels")).alias("x")).select(*keys, "x.*"))
        size = counted(front)
        if not size:
            break
        seen, visited = seen.unionByName(front.select(keys)), visited + size
        found = cut(found.unionByName(hit(front).join(side(found, few_pairs), ends, "left_anti")))
    on = (F.col(start) == F.col("__from")) & (F.col("__rfl") == F.col("__fl")) & (F.col(end) == F.col("__end")) & (F.col("__rel") == F.col("__el"))
    return named.join(side(found, few_pairs), on, "left").drop(*ends, "__rfl", "__rel")
