"""Syntax trees to DataFrames.

A bound node variable `n` is a column `n` with its id and columns `n__p` with its
properties; Catalyst drops those that nothing reads. A value variable is one column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S
from ..functions.scalar import SCALAR, active_at, element_id, overlaps
from ..operators import text as text_search
from ..operators.traverse import edge_key, shortest_path, var_length
from ..plans.catalog import GraphCatalog
from ..plans.joins import FEW, counted, side
from .parser import AsOf, Call, Command, CypherError, Match, Node, Path, Procedure, Projection, Query, Rel, Unwind, Write, parse

FUSIONS = {"rrf_score", "cc_score", "dbsf_score", "doc_score"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}
BOOL_TYPES = {"BOOLEAN": T.BooleanType, "BOOL": T.BooleanType, "STRING": T.StringType, "LIST": T.ArrayType, "MAP": (T.MapType, T.StructType), "TIMESTAMP": (T.TimestampType, T.TimestampNTZType)}


@dataclass(frozen=True)
class Var:
    kind: str  # node, edge, path, value
    columns: tuple[str, ...]  # all that belong to it; the first identifies it
    label: str | None = None

    @property
    def identity(self) -> tuple[str, ...]:
        """The columns that tell entities apart: ids are of a label, so a node is its id and its label."""
        c = self.columns[0]
        return (c, f"{c}____label") if self.kind == "node" and f"{c}____label" in self.columns else (c,)


class X:
    """A compiled expression. shadow: the same with typed nulls for lambda variables, so that it has a type by itself."""

    def __init__(self, col: Column, shadow: Column | None = None, kind: T.DataType | None = None) -> None:
        self.col, self.shadow, self.kind = col, col if shadow is None else shadow, kind


@dataclass
class Env:
    df: DataFrame
    vars: dict[str, Var] = field(default_factory=dict)
    keep: tuple[str, ...] = ()  # columns that projections carry along and group by
    unit: bool = True  # no row source yet

    def type_of(self, x: X) -> T.DataType:
        if x.kind is None:
            x.kind = self.df.select(x.shadow.alias("x")).schema[0].dataType
        return x.kind


def conjuncts(e) -> list:
    return conjuncts(e[2]) + conjuncts(e[3]) if e and e[0] == "logic" and e[1] == "AND" else [e] if e else []


def names_in(e) -> set[str]:
    """Names of variables anywhere in a tree."""
    if isinstance(e, tuple):
        return {e[1]} if len(e) == 2 and e[0] == "var" else set().union(*map(names_in, e))
    if isinstance(e, list):
        return set().union(*map(names_in, e))
    if isinstance(e, dict):
        return set().union(*map(names_in, e.values()))
    if isinstance(e, (Path, Node, Rel, Match, Projection, Unwind, Call, Query)):
        own = {e.var} if isinstance(e, (Node, Rel)) and e.var else set()
        return own.union(*(names_in(v) for v in vars(e).values()))
    return set()


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        if e and e[0] == "call" and e[1].lower() in AGGREGATES:
            return True
        return e[:1] != ("sub",) and any(map(has_aggregate, e))
    return isinstance(e, (list, dict)) and any(map(has_aggregate, e.values() if isinstance(e, dict) else e))


def calls_of(e, names: set[str]) -> list[tuple]:
    """Calls of some functions anywhere in an expression."""
    if isinstance(e, tuple):
        own = [e] if len(e) == 4 and e[0] == "call" and isinstance(e[1], str) and e[1].lower() in names else []
        return own + [c for x in e for c in calls_of(x, names)]
    if isinstance(e, (list, dict)):
        return [c for x in (e.values() if isinstance(e, dict) else e) for c in calls_of(x, names)]
    return []


def replaced(e, old: tuple, new: tuple):
    if e == old:
        return new
    if isinstance(e, tuple):
        return tuple(replaced(x, old, new) for x in e)
    return [replaced(x, old, new) for x in e] if isinstance(e, list) else {k: replaced(x, old, new) for k, x in e.items()} if isinstance(e, dict) else e


class Compiler:
    def __init__(self, catalog: GraphCatalog, params: dict | None = None, strict_numbers: bool = False) -> None:
        self.catalog, self.params, self.strict, self.fresh = catalog, params or {}, strict_numbers, 0

    def new(self, what: str) -> str:
        self.fresh += 1
        return f"__{what}{self.fresh}"

    # queries
    def query(self, q: Query, seed: Env | None = None) -> Env:
        outs = []
        for part in q.parts:
            at = [c.instant for c in part if isinstance(c, AsOf)]
            if at:
                self.catalog = self.catalog.as_of(self.instant(at[-1]))
            env = self.clauses(part, replace(seed, vars=dict(seed.vars)) if seed else Env(self.catalog.spark.range(1).select(F.lit(1).alias("__unit"))))
            outs.append(env)
        first = outs[0]
        names = [*first.vars]
        for o in outs[1:]:
            if [*o.vars] != names:
                raise CypherError("all parts of a UNION return the same columns in the same order")
            first.df = first.df.unionByName(o.df)
        if len(outs) > 1 and not q.all:
            first.df = first.df.distinct()
        return first

    def clauses(self, clauses: list, env: Env) -> Env:
        for c in clauses:
            if isinstance(c, Match):
                env = self.optional(c, env) if c.optional else self.match(c, env)
            elif isinstance(c, Unwind):
                env = self.unwind(c, env)
            elif isinstance(c, Projection):
                env = self.project(c, env)
            elif isinstance(c, Call):
                env = self.call(c, env)
            elif isinstance(c, Procedure):
                env = self.procedure(c, env)
            elif isinstance(c, AsOf):
                pass  # the whole part reads at that instant
            elif isinstance(c, (Write, Command)):
                raise CypherError("this statement runs through Graph.write()")
        return env

    def instant(self, e) -> Column:
        """A constant instant: text, or milliseconds since 1970."""
        x = self.ex(e, Env(self.catalog.spark.range(1)), {})
        t = Env(self.catalog.spark.range(1)).type_of(x)
        return F.timestamp_millis(x.col) if S.is_int(t) else x.col.cast("timestamp")

    def procedure(self, c: Procedure, env: Env) -> Env:
        from ..plans import advisor

        args = [self.params.get(a[1]) if a[0] == "param" else a[1] if a[0] == "lit" else self.constant(a) for a in c.args]
        rows, schema = advisor.procedure(self.catalog, c.name, args)
        df = self.catalog.spark.createDataFrame(rows, schema)
        outputs = c.outputs or [(f, f) for f in df.columns]
        if missing := [n for n, _ in outputs if n not in df.columns]:
            raise CypherError(f"{c.name} has no {missing}")
        df = df.select(*[F.col(n).alias(a) for n, a in outputs])
        return replace(env, df=df if env.unit else env.df.crossJoin(df), vars={**env.vars, **{a: Var("value", (a,)) for _, a in outputs}}, unit=False)

    # patterns
    def scan(self, n: Node, var: str) -> tuple[DataFrame, Var]:
        label = n.labels[0] if n.labels else None
        if label is not None and label not in self.catalog.nodes:
            df = self.catalog.spark.createDataFrame([], "id long, __label string")
        else:
            df = self.catalog.scan(label)
        for other in n.labels[1:]:
            df = df.join(self.catalog.scan(other).select("id"), "id", "left_semi")
        cols = [F.col("id").alias(var)] + [F.col(f"`{c}`").alias(f"{var}__{c}") for c in df.columns if c != "id"]
        out = df.select(cols)
        return out, Var("node", tuple([var, *[c for c in out.columns if c != var]]), label)

    def props(self, df: DataFrame, env: Env, var: Var, name: str, props: dict | None) -> DataFrame:
        for k, e in (props or {}).items():
            at = Env(df, {**env.vars, name: var})
            a, b = self.property(at, var, k), self.ex(e, at, {})
            df = df.where(S.truth(S.equal(a.col, b.col, at.type_of(a), at.type_of(b), self.strict), T.BooleanType()))
        return df

    def bind_node(self, n: Node, env: Env) -> str:
        """Makes sure that the node is bound; joins its table to all rows if it was not."""
        name = n.var or self.new("n")
        if name in env.vars:
            v = env.vars[name]
            for label in n.labels:
                if v.label is None and f"{name}____label" in v.columns:
                    env.df = env.df.where(F.col(f"{name}____label") == label)
                elif v.label != label:
                    env.df = env.df.join(self.catalog.scan(label).select(F.col("id").alias("__has")), F.col(name) == F.col("__has"), "left_semi") if label in self.catalog.nodes else env.df.where(F.lit(False))
            env.df = self.props(env.df, env, v, name, n.props)
            return name
        df, v = self.scan(n, name)
        env.df = df if env.unit else env.df.crossJoin(df)
        env.df = self.props(env.df, env, v, name, n.props)
        env.unit = False
        env.vars[name] = v
        return name

    def infer(self, n: Node, r: Rel, reverse: bool, start: str | None) -> Node:
        """The label that the edge types' declarations leave for an unlabelled end."""
        if n.labels:
            return n
        forward = (r.direction == "out") != reverse
        types = [e for t in r.types or [*self.catalog.edges] if (e := self.catalog.edges.get(t))]
        ends = {e.target if forward else e.source for e in types}
        if r.direction == "both":
            ends |= {e.source if forward else e.target for e in types}
        if r.hops and r.hops[0] == 0:
            ends.add(start)
        return replace(n, labels=[*ends]) if len(ends) == 1 and None not in ends else n

    def expand(self, env: Env, left: str, r: Rel, n: Node, reverse: bool, path: str | None = None, distinct: bool = False) -> str:
        direction = {"out": "in", "in": "out", "both": "both"}[r.direction] if reverse else r.direction
        types = [t for t in r.types if t in self.catalog.edges]
        edges = self.catalog.edges_of(types, direction) if types or not r.types else self.catalog.edges_of([], direction).where(F.lit(False))
        for k, e in (r.props or {}).items():
            edges = edges.where(F.col(k) == self.ex(e, env, {}).col) if k in edges.columns else edges.where(F.lit(False))
        n = self.infer(n, r, reverse, env.vars[left].label)
        name = n.var or self.new("n")
        if r.hops:
            target = self.new("t")
            env.df = var_length(env.df, left, edges, r.hops[0], r.hops[1], target, path, distinct, r.var)
            if r.var:
                if reverse:
                    env.df = env.df.withColumn(r.var, F.reverse(r.var))
                env.vars[r.var] = Var("value", (r.var,))
        else:
            ev = r.var or self.new("r")
            own = [c for c in edges.columns if c not in ("src", "dst", "__type", "__a", "__b", "__sl", "__dl")]
            e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), "__sl", "__dl", edge_key().alias(ev), F.col("__type").alias(f"{ev}____type"), F.col("__a").alias(f"{ev}____src"), F.col("__b").alias(f"{ev}____tgt"), *[F.col(f"`{c}`").alias(f"{ev}__{c}") for c in own])
            bound = ev in env.vars
            if bound:
                e = e.select("__s", "__d", "__sl", "__dl", F.col(ev).alias("__ev"))
            # Ids are of a label: an edge's declared ends must be the nodes' labels.
            on = (env.df[left] == e["__s"]) & self.labelled(env.df, left, "__sl")
            env.df = env.df.join(e, on & (env.df[ev] == e["__ev"]) if bound else on).drop("__s", "__ev", "__sl")
            target = "__d"
            if not bound:
                env.vars[ev] = Var("edge", (ev, f"{ev}____type", f"{ev}____src", f"{ev}____tgt", *[f"{ev}__{c}" for c in own]))
        declared = "__dl" in env.df.columns
        if name in env.vars:
            same = F.col(name) == F.col(target)
            env.df = env.df.where(same & self.labelled(env.df, name, "__dl") if declared else same).drop(target, "__dl")
            self.bind_node(replace(n, var=name), env)
            return name
        right, v = self.scan(n, name)
        right = self.props(right, env, v, name, n.props)
        if r.hops and counted(right) > FEW:
            right = side(right, False)
        same = env.df[target] == right[name]
        env.df = env.df.join(right, same & self.labelled(right, name, "__dl") if declared else same).drop(target, "__dl")
        env.vars[name] = v
        return name

    def labelled(self, df: DataFrame, name: str, end: str) -> Column:
        has = f"{name}____label"
        return F.col(end).isNull() | (F.col(has) == F.col(end)) if has in df.columns else F.lit(True)

    def path(self, p: Path, env: Env, distinct: bool = False) -> None:
        if p.shortest:
            a, b = self.bind_node(p.nodes[0], env), self.bind_node(p.nodes[1], env)
            r = p.rels[0]
            name = p.var or self.new("p")
            env.df = shortest_path(env.df, a, b, self.catalog.edges_of(r.types, r.direction), name, r.hops[1] if r.hops else 1)
            env.vars[name] = Var("path", (name,))
            return
        if p.var and len(p.rels) > 1:
            raise CypherError("a path variable takes a single relationship")
        start = next((i for i, n in enumerate(p.nodes) if n.var in env.vars), 0)
        names = {start: self.bind_node(p.nodes[start], env)}
        name = p.var if p.var and p.rels and p.rels[0].hops else None
        for i in range(start, len(p.rels)):
            names[i + 1] = self.expand(env, names[i], p.rels[i], p.nodes[i + 1], False, name, distinct)
        for i in range(start - 1, -1, -1):
            names[i] = self.expand(env, names[i + 1], p.rels[i], p.nodes[i], True, name, distinct)
        if name and start:
            env.df = env.df.withColumn(name, F.struct(F.reverse(F.col(name)["nodes"]).alias("nodes"), F.reverse(F.col(name)["rels"]).alias("rels")))
        if p.var and not name:
            rels = F.array().cast("array<struct<type:string,source:bigint,target:bigint>>")
            if p.rels:
                ev = [v for v in env.vars if env.vars[v].kind == "edge"][-1]
                rels = F.array(F.struct(F.col(f"{ev}____type").alias("type"), F.col(f"{ev}____src").alias("source"), F.col(f"{ev}____tgt").alias("target")))
            env.df = env.df.withColumn(p.var, F.struct(F.array(*[F.col(names[i]) for i in range(len(p.nodes))]).alias("nodes"), rels.alias("rels")))
        if p.var:
            env.vars[p.var] = Var("path", (p.var,))

    def match(self, m: Match, env: Env, distinct: bool = False) -> Env:
        env = replace(env, vars=dict(env.vars))
        for p in m.paths:
            self.path(p, env, distinct)
        for c in conjuncts(m.where):
            self.filter(c, env)
        return env

    def filter(self, e, env: Env) -> None:
        """Keeps rows for which e holds; patterns become semi and anti joins."""
        if fused := calls_of(e, FUSIONS):
            raise CypherError(f"{fused[0][1]}() ranks all rows and cannot stand in WHERE")
        negated, inner = (True, e[1]) if e[0] == "not" else (False, e)
        if inner[0] in ("pattern", "sub") and (inner[0] == "pattern" or inner[1] == "EXISTS"):
            m = Match([inner[1]]) if inner[0] == "pattern" else inner[2]
            keys, body = self.seeded(m, env)
            found = body.df.select([F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
            on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
            env.df = env.df.join(found, on, "left_anti" if negated else "left_semi")
            return
        if e[0] == "call" and e[1].lower() == "text_match":
            return self.text_match(e, env)
        x = self.ex(e, env, {})
        env.df = env.df.where(S.truth(x.col, env.type_of(x)))
        if e[0] == "cmp" and (near := calls_of(e[2:], {"vector_similarity", "vector_distance", "vector_manhattan"})):
            # What hybrid_score() blends: the vector score that rows were filtered by, in 0 to 1.
            v = self.ex(near[0], env, {}).col
            env.df = env.df.withColumn("__vector_score", (v + 1) / 2 if near[0][1].lower() == "vector_similarity" else 1 / (1 + v))
            env.vars["__vector_score"] = Var("value", ("__vector_score",))

    # rank fusion
    def fused(self, items: list, env: Env) -> list:
        """The expressions with fusion scores as new columns of the rows."""
        found = list(dict.fromkeys(map(repr, calls_of([e for e, _ in items], FUSIONS))))
        if len([c for c in found if "'doc_score'" not in c]) > 1:
            raise CypherError("one projection takes one of rrf_score(), cc_score() and dbsf_score(); put another after WITH")
        for call in {repr(c): c for c in calls_of([e for e, _ in items], FUSIONS)}.values():
            name = self.new("fused")
            (self.doc_score if call[1].lower() == "doc_score" else self.rank_fuse)(call, name, env)
            env.vars[name] = Var("value", (name,))
            items = [(replaced(e, call, ("var", name)), n) for e, n in items]
        return items

    def static(self, e):
        """A literal, list, map or parameter as a Python value."""
        if e[0] == "neg":
            return -self.static(e[1])
        if e[0] == "map":
            return {k: self.static(x) for k, x in e[1].items()}
        if e[0] == "list":
            return [self.static(x) for x in e[1]]
        if e[0] in ("lit", "param"):
            return e[1] if e[0] == "lit" else self.params.get(e[1])
        raise CypherError("a fusion score takes literals and parameters")

    def rank_fuse(self, call: tuple, out: str, env: Env) -> None:
        from ..functions import vector
        from ..operators import fusion

        name, args = call[1].lower(), call[3] or []
        if name == "rrf_score" and len(args) > 2:
            raise CypherError("rrf_score() has k=60, which is not tunable")
        if len(args) < 2 or args[0][0] != "list" or not args[0][1]:
            raise CypherError(f"{name}() takes a non-empty list of properties and a query map")
        query = self.static(args[1])
        if not isinstance(query, dict) or not query or (odd := set(query) - {"vector", "text"}):
            raise CypherError(f"{name}() knows the query keys vector and text, not {sorted(odd) if query else query}")
        weights = self.static(args[2]) if len(args) > 2 else {}
        if name != "rrf_score" and (not isinstance(weights, dict) or not weights or set(weights) - {"vector", "text"}):
            raise CypherError(f"{name}() takes weights for vector and text")
        columns: dict[str, float] = {}
        for i, m in enumerate(args[0][1]):
            if m[0] != "prop" or m[1][0] != "var" or m[1][1] not in env.vars or env.vars[m[1][1]].kind != "node":
                raise CypherError(f"{name}() takes property accesses")
            var, prop, c = m[1][1], m[2], f"{out}_{i}"
            v = env.vars[var]
            t = env.type_of(self.property(env, v, prop))
            if S.is_list(t) and "vector" in query:
                kind, q = "vector", F.array(*[F.lit(float(x)) for x in query["vector"]])
                env.df = env.df.withColumn(c, vector.vector_similarity(self.property(env, v, prop).col, q))
            elif S.is_text(t) and "text" in query:
                kind = "text"
                docs = self.catalog.scan(v.label).select("id", F.col(prop).alias("text"))
                scores = text_search.search(docs, query["text"]).select(F.col("id").alias("__doc"), F.col("score").alias(c))
                env.df = env.df.join(scores, env.df[var] == scores["__doc"], "left").drop("__doc")
            else:
                raise CypherError(f"{name}(): {var}.{prop} cannot be scored by {sorted(query)}")
            if name == "rrf_score" or kind in weights:
                columns[c] = float(weights.get(kind, 1))
        if name == "rrf_score":
            env.df = fusion.rrf(env.df, [*columns], out)
        else:
            env.df = (fusion.convex if name == "cc_score" else fusion.dbsf)(env.df, columns, out)

    def doc_score(self, call: tuple, out: str, env: Env) -> None:
        from ..functions import vector
        from ..operators import fusion

        args = call[3] or []
        v = env.vars.get(args[0][1]) if len(args) >= 2 and args[0][0] == "var" else None
        if v is None or v.kind != "node":
            raise CypherError("doc_score() takes a document and a query vector")
        q = self.static(args[1])
        q = q.get("vector") if isinstance(q, dict) else q
        options = self.static(args[2]) if len(args) > 2 else {}
        if isinstance(options, (int, float)):
            options = dict(zip(("alpha", "beta", "gamma"), map(self.static, args[2:5])))
        if not isinstance(options, dict) or (odd := set(options) - {"alpha", "beta", "gamma"}):
            raise CypherError(f"doc_score() takes alpha, beta and gamma, not {sorted(odd) if isinstance(options, dict) else options}")
        edge = self.catalog.edges.get("HAS_CHUNK")
        label = edge.target if edge else None
        nodes = self.catalog.scan(label)
        vectors = [f.name for f in nodes.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
        if edge is None or not vectors or not isinstance(q, list):
            raise CypherError("doc_score() needs HAS_CHUNK edges to nodes with a vector, and a query vector")
        sim = vector.vector_similarity(F.col(vectors[0]), F.array(*[F.lit(float(x)) for x in q]))
        ends = edge.rows().select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
        chunks = ends.join(nodes.select("id", sim.alias("sim")), F.col("__dst") == F.col("id")).select(F.col("__src").alias("id"), "sim")
        env.df = fusion.doc_score(env.df, chunks, "sim", id="id", doc=v.columns[0], out=out, **{k: float(x) for k, x in options.items()})

    def text_match(self, e, env: Env) -> None:
        (_, base, prop), query = e[3][0], self.ex(e[3][1], env, {})
        if e[3][1][0] not in ("lit", "param"):
            raise CypherError("text_match takes a literal query")
        var = base[1]
        wanted = e[3][1][1] if e[3][1][0] == "lit" else self.params.get(e[3][1][1])
        _ = query
        docs = self.catalog.scan(env.vars[var].label).select(F.col("id"), F.col(prop).alias("text"))
        scored = text_search.search(docs, wanted).select(F.col("id").alias("__doc"), F.col("score").alias("__text_score"))
        env.df = env.df.drop("__text_score").join(scored, env.df[var] == scored["__doc"]).drop("__doc")
        env.vars["__text_score"] = Var("value", ("__text_score",))

    def seeded(self, body: Match | Query, env: Env, imports: list[str] | None = None) -> tuple[list[str], Env]:
        """(columns that identify an outer row for the body, the body run on the distinct such rows)."""
        used = names_in(body) if imports is None else set(imports)
        outer = [v for v in env.vars if v in used]
        keys = list(dict.fromkeys(c for v in outer for c in env.vars[v].identity))
        columns = list(dict.fromkeys(c for v in outer for c in env.vars[v].columns))
        if not outer:
            seed = Env(self.catalog.spark.range(1).select(F.lit(1).alias("__unit")))
        else:
            seed = Env(env.df.select(columns).dropDuplicates(keys), {v: env.vars[v] for v in outer}, tuple(keys), False)
        if isinstance(body, Match):
            return keys, self.match(body, seed)
        return keys, self.query(body, seed)

    def optional(self, m: Match, env: Env) -> Env:
        if env.unit:
            out = self.match(m, env)
            one = self.catalog.spark.range(1).select(F.lit(1).alias("__one"))
            out.df = one.join(out.df.withColumn("__hit", F.lit(1)), F.col("__one") == F.col("__hit"), "left").drop("__one", "__hit")
            return out
        keys, body = self.seeded(m, env)
        new = {v: b for v, b in body.vars.items() if v not in env.vars}
        right = body.df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *dict.fromkeys(c for b in new.values() for c in b.columns))
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] or F.lit(True)
        df = env.df.join(right, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        return replace(env, df=df, vars={**env.vars, **new})

    def unwind(self, u: Unwind, env: Env) -> Env:
        x = self.ex(u.expr, env, {})
        t = env.type_of(x)
        items = x.col if S.is_list(t) else F.array(x.col) if not isinstance(t, T.NullType) else F.array().cast("array<string>")
        df = env.df.withColumn(u.var, F.explode(items)) if u.var not in env.df.columns else env.df.drop(u.var).withColumn(u.var, F.explode(items))
        return replace(env, df=df, vars={**env.vars, u.var: Var("value", (u.var,))}, unit=False)

    def call(self, c: Call, env: Env) -> Env:
        if c.imports is None and not env.unit:
            body = self.query(c.body)
            df = body.df.select(*[F.col(f"`{x}`") for v in body.vars.values() for x in v.columns])
            df = env.df.join(df, F.lit(True), "left") if c.optional else env.df.crossJoin(df)
            return replace(env, df=df, vars={**env.vars, **body.vars})
        keys, body = self.seeded(c.body, env, c.imports or [])
        new = {v: b for v, b in body.vars.items() if v not in env.vars}
        right = body.df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{x}`") for b in new.values() for x in b.columns])
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        last = c.body.parts[0][-1]
        lone = isinstance(last, Projection) and all(has_aggregate(e) for e, _ in last.items)
        df = right if not keys else env.df.join(right, on, "left" if c.optional or lone else "inner").drop(*[f"__k{i}" for i in range(len(keys))])
        if lone:
            zero = {name: 0 for e, name in last.items if e[:1] == ("call",) and e[1].lower() == "count"}
            df = df.fillna(zero) if zero else df
        return replace(env, df=df, vars={**env.vars, **new}, unit=False)

    # projections
    def project(self, p: Projection, env: Env) -> Env:
        env = replace(env, vars=dict(env.vars))
        items = [(("var", v), v) for v in env.vars if not v.startswith("__")] if p.star else []
        items += p.items
        n_items = len(items)
        both = self.fused([*items, *[(e, None) for e, _ in p.order]], env)
        items, p = both[:n_items], replace(p, order=[(e, asc) for (e, _), (_, asc) in zip(both[n_items:], p.order, strict=True)])
        order, grouped = p.order, any(has_aggregate(e) for e, _ in items)
        if p.distinct and not grouped or grouped:
            known = {repr(e): n for e, n in items}
            order = [(("var", known[repr(e)]), asc) if repr(e) in known else (e, asc) for e, asc in order]
        if grouped:
            out = self.aggregate(items, env)
        else:
            out = Env(env.df, {}, env.keep, False)
            columns, sort = [F.col(k) for k in env.keep], []
            done = set(env.keep)
            computed = [(e, n, self.value(e, env)) for e, n in items]
            mixed = Env(env.df, dict(env.vars), env.keep, False)
            for e, n, x in computed:
                if x is None:  # a node, edge or path under its own or another name
                    v = env.vars[e[1]]
                    cols = tuple(n + c[len(e[1]) :] if c.startswith(e[1]) else c for c in v.columns)
                    for a, b in zip(v.columns, cols, strict=True):
                        if b not in done:
                            columns.append(F.col(f"`{a}`").alias(b))
                            done.add(b)
                    out.vars[n] = replace(v, columns=cols)
                else:
                    if n not in done:
                        columns.append(x.col.alias(n))
                        done.add(n)
                    out.vars[n] = Var("value", (n,))
            for i, (e, asc) in enumerate(order):
                alias = next((x for _, n, x in computed if e == ("var", n) and x is not None), None)
                x = alias or self.ex(e, mixed, {})
                sort.append((f"__o{i}", asc))
                if not p.distinct:
                    columns.append(x.col.alias(f"__o{i}"))
            out.df = mixed.df.select(columns)
            cached = [] if p.final else [c for c in ("__text_score", "__vector_score") if c in env.vars and c not in done]
            if cached:
                out.df = mixed.df.select(*columns, *cached)
                out.vars.update({c: env.vars[c] for c in cached})
            if p.distinct:
                out.df = out.df.distinct()
        if grouped or p.distinct:
            for i, (e, _) in enumerate(order):
                out.df = out.df.withColumn(f"__o{i}", self.ex(e, out, {}).col)
        keys = [F.col(f"__o{i}").asc_nulls_last() if asc else F.col(f"__o{i}").desc_nulls_first() for i, (_, asc) in enumerate(order)]
        if keys:
            out.df = out.df.orderBy(*keys)
        if p.skip is not None:
            out.df = out.df.offset(self.constant(p.skip))
        if p.limit is not None:
            out.df = out.df.limit(self.constant(p.limit))
        out.df = out.df.drop(*[f"__o{i}" for i in range(len(order))])
        for c in conjuncts(p.where):
            self.filter(c, out)
        return out

    def value(self, e, env: Env) -> X | None:
        """The expression, or None for an entity that stays bound."""
        if e[0] == "var" and e[1] in env.vars and env.vars[e[1]].kind in ("node", "edge"):
            return None
        return self.ex(e, env, {})

    def constant(self, e) -> int:
        if e[0] == "lit":
            return int(e[1])
        if e[0] == "param":
            return int(self.params[e[1]])
        return int(self.catalog.spark.range(1).select(self.ex(e, Env(self.catalog.spark.range(1)), {}).col).first()[0])

    def aggregate(self, items: list, env: Env) -> Env:
        keys = [(e, n) for e, n in items if not has_aggregate(e)]
        calls: list[tuple] = []

        def lift(e):
            """e with each aggregate replaced by a variable."""
            if isinstance(e, tuple):
                if e[:1] == ("call",) and e[1].lower() in AGGREGATES:
                    if e not in calls:
                        calls.append(e)
                    return ("var", f"__g{calls.index(e)}")
                return tuple(map(lift, e))
            return [*map(lift, e)] if isinstance(e, list) else {k: lift(v) for k, v in e.items()} if isinstance(e, dict) else e

        after = [(lift(e), n) for e, n in items]
        columns, group, out_vars = [], list(env.keep), {}
        for e, n in keys:
            x = self.value(e, env)
            if x is None:
                v = env.vars[e[1]]
                cols = tuple(n + c[len(e[1]) :] if c.startswith(e[1]) else c for c in v.columns)
                columns += [F.col(f"`{a}`").alias(b) for a, b in zip(v.columns, cols, strict=True) if b not in env.keep]
                out_vars[n] = replace(v, columns=cols)
                group += out_vars[n].identity
            else:
                if n not in env.keep:
                    columns.append(x.col.alias(n))
                group.append(n)
                out_vars[n] = Var("value", (n,))
        aggs = []
        for i, c in enumerate(calls):
            args = [self.ex(a, env, {}) for a in c[3] or []]
            if c[1].lower() == "count" and c[2] and (v := env.vars.get(c[3][0][1]) if c[3][0][0] == "var" else None) and len(v.identity) > 1:
                args = [X(F.when(F.col(v.identity[0]).isNotNull(), F.struct(*v.identity)))]
            columns += [a.col.alias(f"__a{i}_{j}") for j, a in enumerate(args)]
            aggs.append(self.aggregate_call(c, i, [env.type_of(a) for a in args]).alias(f"__g{i}"))
        df = env.df.select(*[F.col(k) for k in env.keep], *columns)
        carried = [c for v in out_vars.values() for c in v.columns if c not in group]
        aggs += [F.first(F.col(f"`{c}`")).alias(c) for c in carried]
        group = list(dict.fromkeys(group))
        df = df.groupBy(*[F.col(f"`{g}`") for g in group]).agg(*aggs) if group else df.agg(*aggs)
        mid = Env(df, {**out_vars, **{f"__g{i}": Var("value", (f"__g{i}",)) for i in range(len(calls))}}, env.keep, False)
        columns, final = [F.col(k) for k in env.keep], {}
        for e, n in after:
            if n in out_vars:
                columns += [F.col(f"`{c}`") for c in out_vars[n].columns if c not in env.keep]
                final[n] = out_vars[n]
            else:
                columns.append(self.ex(e, mid, {}).col.alias(n))
                final[n] = Var("value", (n,))
        return Env(mid.df.select(columns), final, env.keep, False)

    def aggregate_call(self, c, i: int, types: list) -> Column:
        name, distinct = c[1].lower(), c[2]
        if c[3] is None:
            return F.count(F.lit(1))
        x = F.col(f"__a{i}_0")
        share = None
        if name.startswith("percentile"):
            share = c[3][1] if len(c[3]) > 1 else ("lit", 0.5)
            share = float(share[1] if share[0] == "lit" else self.params[share[1]])
            share = min(1.0, max(0.0, share))
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "collect":
            return F.collect_set(x) if distinct else F.collect_list(x)
        if name == "percentilecont":
            return F.percentile(x.cast("double"), share)
        if name == "percentiledisc":
            return F.expr(f"cast(percentile_disc({share}D) within group (order by `__a{i}_0`) as double)")
        if name == "sum":
            return F.sum_distinct(x) if distinct else F.sum(x)
        return {"avg": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}[name](x)

    # expressions
    def property(self, env: Env, v: Var, name: str) -> X:
        c = f"{v.columns[0]}__{name}"
        return X(F.col(f"`{c}`")) if c in v.columns else X(F.lit(None), kind=T.NullType())

    def ap(self, f: Callable[..., Column], *xs: X, kind=None) -> X:
        return X(f(*[x.col for x in xs]), f(*[x.shadow for x in xs]), kind)

    def ex(self, e, env: Env, scope: dict[str, X]) -> X:
        return getattr(self, "ex_" + e[0])(e, env, scope)

    def many(self, es, env, scope):
        return [self.ex(e, env, scope) for e in es]

    def ex_lit(self, e, env, scope):
        v = e[1]
        if isinstance(v, int) and not isinstance(v, bool):
            return X(F.lit(v).cast("long"), kind=T.LongType())
        kinds = {bool: T.BooleanType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        return X(F.lit(v), kind=kinds[type(v)])

    def ex_param(self, e, env, scope):
        return self.python(self.params.get(e[1]), env)

    def python(self, v, env) -> X:
        if isinstance(v, (list, tuple)):
            items = [self.python(x, env).col for x in v]
            return X(F.array(*items))
        if isinstance(v, dict):
            return X(F.struct(*[self.python(x, env).col.alias(k) for k, x in v.items()]))
        return self.ex_lit(("lit", v), env, {})

    def ex_var(self, e, env, scope):
        if e[1] in scope:
            return scope[e[1]]
        if e[1] not in env.vars:
            raise CypherError(f"{e[1]} is not defined")
        return X(F.col(f"`{env.vars[e[1]].columns[0]}`"))

    def ex_prop(self, e, env, scope):
        base = e[1]
        if base[0] == "var" and base[1] not in scope and base[1] in env.vars and env.vars[base[1]].kind in ("node", "edge"):
            return self.property(env, env.vars[base[1]], e[2])
        x = self.ex(base, env, scope)
        t = env.type_of(x)
        if isinstance(t, T.StructType):
            return self.ap(lambda c: c[e[2]], x) if e[2] in t.names else X(F.lit(None), kind=T.NullType())
        if isinstance(t, T.MapType):
            return self.ap(lambda c: F.try_element_at(c, F.lit(e[2])), x)
        if isinstance(t, T.StringType):  # a document kept as JSON text
            return self.ap(lambda c: F.get_json_object(c, "$." + e[2]), x)
        if isinstance(t, T.VariantType):
            return self.ap(lambda c: F.try_variant_get(c, "$." + e[2], "variant"), x)
        return X(F.lit(None), kind=T.NullType())

    def ex_logic(self, e, env, scope):
        a, b = self.ex(e[2], env, scope), self.ex(e[3], env, scope)
        if any(not isinstance(env.type_of(x), T.BooleanType) for x in (a, b)):
            return X(F.lit(None).cast("boolean"), kind=T.BooleanType())
        return self.ap(lambda x, y: S.both(e[1], x, y), a, b, kind=T.BooleanType())

    def ex_not(self, e, env, scope):
        a = self.ex(e[1], env, scope)
        return self.ap(lambda x: ~x, a, kind=T.BooleanType()) if isinstance(env.type_of(a), T.BooleanType) else X(F.lit(None).cast("boolean"), kind=T.BooleanType())

    def ex_cmp(self, e, env, scope):
        a, b = self.ex(e[2], env, scope), self.ex(e[3], env, scope)
        ta, tb, op = env.type_of(a), env.type_of(b), e[1]
        ends = [env.vars[x[1]] for x in e[2:] if x[0] == "var" and x[1] not in scope and x[1] in env.vars]
        if op in ("=", "<>") and len(ends) == 2 and all(len(v.identity) > 1 for v in ends):
            same = (a.col == b.col) & (F.col(ends[0].identity[1]) == F.col(ends[1].identity[1]))
            return X(same if op == "=" else ~same, kind=T.BooleanType())
        if op == "=~":
            if not (S.is_text(ta) and S.is_text(tb)):
                return X(F.lit(None).cast("boolean"), kind=T.BooleanType())
            if e[3][0] in ("lit", "param") and not self.compiles(e[3][1] if e[3][0] == "lit" else self.params.get(e[3][1])):
                return self.ap(lambda x: F.when(x.isNotNull(), F.lit(False)), a, kind=T.BooleanType())
            return self.ap(lambda x, p: F.rlike(x, F.concat(F.lit("^(?:"), p, F.lit(")$"))), a, b, kind=T.BooleanType())
        if op == "=":
            f = lambda x, y: S.equal(x, y, ta, tb, self.strict)
        elif op == "<>":
            f = lambda x, y: ~S.equal(x, y, ta, tb, self.strict)
        else:
            f = lambda x, y: S.order(op, x, y, ta, tb)
        return self.ap(f, a, b, kind=T.BooleanType())

    def compiles(self, pattern) -> bool:
        """Whether the executors' regular expressions take a constant pattern; one that they do not matches nothing."""
        try:
            self.catalog.spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # noqa: BLE001  whatever the pattern's syntax error is
            return False
        return True

    def ex_math(self, e, env, scope):
        a, b = self.ex(e[2], env, scope), self.ex(e[3], env, scope)
        f = {"+": S.add, "-": S.subtract, "*": S.multiply, "/": S.divide, "%": S.modulo}[e[1]]
        ta, tb = env.type_of(a), env.type_of(b)
        return self.ap(lambda x, y: f(x, y, ta, tb), a, b)

    def ex_neg(self, e, env, scope):
        a = self.ex(e[1], env, scope)
        t = env.type_of(a)
        return self.ap(lambda x: S.negate(x, t), a)

    def ex_in(self, e, env, scope):
        a, b = self.ex(e[1], env, scope), self.ex(e[2], env, scope)
        t = env.type_of(b)
        return self.ap(lambda x, y: S.contained(x, y, t), a, b, kind=T.BooleanType())

    def ex_text(self, e, env, scope):
        a, b = self.ex(e[2], env, scope), self.ex(e[3], env, scope)
        f = {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[e[1]]
        if not (S.is_text(env.type_of(a)) and S.is_text(env.type_of(b))):
            return X(F.lit(None).cast("boolean"), kind=T.BooleanType())
        return self.ap(f, a, b, kind=T.BooleanType())

    def ex_isnull(self, e, env, scope):
        a = self.ex(e[1], env, scope)
        return self.ap((lambda x: x.isNotNull()) if e[2] else (lambda x: x.isNull()), a, kind=T.BooleanType())

    def ex_istype(self, e, env, scope):
        a = self.ex(e[1], env, scope)
        t = env.type_of(a)
        is_it = S.is_int(t) if e[2] in ("INTEGER", "INT") else S.is_float(t) if e[2] == "FLOAT" else isinstance(t, BOOL_TYPES.get(e[2], ()))
        return self.ap(lambda x: (x.isNotNull() & F.lit(is_it)) if not e[3] else ~(x.isNotNull() & F.lit(is_it)), a, kind=T.BooleanType())

    def ex_list(self, e, env, scope):
        xs = self.many(e[1], env, scope)
        return self.ap(lambda *c: F.array(*c), *xs) if xs else X(F.array())

    def ex_map(self, e, env, scope):
        xs = self.many(e[1].values(), env, scope)
        return self.ap(lambda *c: F.struct(*[v.alias(k) for k, v in zip(e[1], c, strict=True)]), *xs)

    def ex_mapproj(self, e, env, scope):
        items = []
        for k, v in e[2]:
            if k == "star":
                var = env.vars[e[1][1]]
                items += [(c[len(var.columns[0]) + 2 :], X(F.col(f"`{c}`"))) for c in var.columns[1:] if "____" not in c]
            else:
                items.append((k, self.ex(v, env, scope)))
        return self.ap(lambda *c: F.struct(*[v.alias(k) for (k, _), v in zip(items, c, strict=True)]), *[x for _, x in items])

    def ex_index(self, e, env, scope):
        a, i = self.ex(e[1], env, scope), self.ex(e[2], env, scope)
        t = env.type_of(a)
        if isinstance(t, T.StructType) and e[2][0] == "lit":
            return self.ap(lambda c: c[e[2][1]], a) if e[2][1] in t.names else X(F.lit(None), kind=T.NullType())
        return self.ap(lambda x, y: S.subscript(x, y, t), a, i)

    def ex_slice(self, e, env, scope):
        xs = [self.ex(x, env, scope) for x in e[1:] if x is not None]
        has = [x is not None for x in e[1:]]

        def f(*c):
            c = iter(c)
            a, lo, hi = (next(c) if h else None for h in has)
            return S.list_slice(a, lo, hi)

        return self.ap(f, *xs)

    def ex_case(self, e, env, scope):
        base = self.ex(e[1], env, scope) if e[1] else None
        pairs = [(self.ex(c, env, scope), self.ex(v, env, scope)) for c, v in e[2]]
        other = self.ex(e[3], env, scope) if e[3] else None
        flat = [x for p in pairs for x in p] + ([base] if base else []) + ([other] if other else [])

        def f(*c):
            n = 2 * len(pairs)
            b = c[n] if base else None
            out = None
            for i in range(0, n, 2):
                cond = b.eqNullSafe(c[i]) if base else c[i]
                out = F.when(cond, c[i + 1]) if out is None else out.when(cond, c[i + 1])
            return out.otherwise(c[-1]) if other else out

        return self.ap(f, *flat)

    def over(self, var: str, items: X, env: Env, scope: dict, body, make: Callable) -> X:
        """make(items, function of an element) with the body compiled for elements of the list."""
        t = env.type_of(items)
        if not S.is_list(t):
            return X(F.lit(None), kind=T.NullType())
        dummy = F.lit(None).cast(t.elementType)

        def inside(c: Column) -> X:
            return self.ex(body, env, {**scope, var: X(c, dummy, t.elementType)}) if body is not None else X(c, dummy, t.elementType)

        def shadow(c: Column) -> Column:
            return inside(dummy).shadow

        return X(make(items.col, lambda c: inside(c).col), make(items.shadow, shadow))

    def ex_comp(self, e, env, scope):
        _, var, items, where, expr = e
        x = self.ex(items, env, scope)
        if where is not None:
            x = self.over(var, x, env, scope, where, lambda a, f: F.filter(a, lambda c: F.coalesce(f(c), F.lit(False))))
        return self.over(var, x, env, scope, expr, F.transform) if expr is not None else x

    def ex_quant(self, e, env, scope):
        _, kind, var, items, pred = e
        x = self.ex(items, env, scope)

        def make(a, f):
            hits, n = F.size(F.filter(a, lambda c: F.coalesce(f(c), F.lit(False)))), F.size(a)
            return F.when(a.isNotNull(), {"ALL": hits == n, "ANY": hits > 0, "NONE": hits == 0, "SINGLE": hits == 1}[kind])

        return self.over(var, x, env, scope, pred, make)

    def ex_reduce(self, e, env, scope):
        _, acc, init, var, items, body = e
        x, start = self.ex(items, env, scope), self.ex(init, env, scope)
        t = env.type_of(x).elementType
        kind = env.type_of(start)
        run = lambda a, c, k: self.ex(body, env, {**scope, acc: X(a, F.lit(None).cast(k), k), var: X(c, F.lit(None).cast(t), t)})
        grown = env.type_of(X(run(F.lit(None).cast(kind), F.lit(None).cast(t), kind).shadow))
        f = lambda items, start: F.aggregate(items, start.cast(grown), lambda a, c: run(a, c, grown).col.cast(grown))
        return X(f(x.col, start.col), F.lit(None).cast(grown), grown)

    def ex_pattern(self, e, env, scope):
        return self.sub("EXISTS", Match([e[1]]), None, env)

    def ex_sub(self, e, env, scope):
        return self.sub(e[1], e[2], e[3], env)

    def sub(self, kind: str, m: Match, value, env: Env) -> X:
        """A correlated subquery's value as a new column of the rows."""
        keys, body = self.seeded(m, env)
        name = self.new("q")
        if kind == "COLLECT":
            x = self.ex(value, body, {})
            agg = F.collect_list(F.col("__v")).alias(name)
            inner = body.df.select(*keys, x.col.alias("__v"))
            empty = F.array().cast(T.ArrayType(body.type_of(x)))
        else:
            agg, inner, empty = F.count(F.lit(1)).alias(name), body.df, F.lit(0).cast("long")
        got = inner.groupBy(*keys).agg(agg)
        got = got.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], name)
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] or F.lit(True)
        env.df = env.df.join(got, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        out = F.coalesce(F.col(name), empty)
        return X(out > 0, kind=T.BooleanType()) if kind == "EXISTS" else X(out)

    def ex_call(self, e, env, scope):
        name, args = e[1].lower(), e[3] or []
        entity = env.vars.get(args[0][1]) if args and args[0][0] == "var" and args[0][1] not in scope else None
        if entity and entity.kind in ("node", "edge"):
            c, own = entity.columns[0], [x for x in entity.columns[1:] if "____" not in x]
            short = lambda x: x[len(c) + 2 :]
            if name == "id":
                return X(F.col(c))
            if name == "elementid":
                return X(element_id(F.col(c)))
            if name == "labels":
                return X(F.when(F.col(c).isNotNull(), F.array(F.col(f"{c}____label"))))
            if name == "type":
                return X(F.col(f"{c}____type"))
            if name in ("startnode", "endnode"):
                return X(F.col(f"{c}____src" if name == "startnode" else f"{c}____tgt"))
            if name == "keys":
                return X(F.filter(F.array(*[F.when(F.col(f"`{x}`").isNotNull(), F.lit(short(x))) for x in sorted(own)]), lambda x: x.isNotNull()))
            if name == "properties":
                return X(F.struct(*[F.col(f"`{x}`").alias(short(x)) for x in own]))
            if name in ("temporal_active_at", "temporal_overlaps"):
                if f"{c}__valid_from" not in entity.columns:
                    return X(F.lit(False), kind=T.BooleanType())
                f = active_at if name == "temporal_active_at" else overlaps
                at = [self.ex(a, env, scope).col for a in args[1:]]
                return X(f(F.col(f"{c}__valid_from"), F.col(f"{c}__valid_to"), *at), kind=T.BooleanType())
        if name == "text_score":
            if "__text_score" not in env.vars:
                raise CypherError("text_score needs text_match")
            return X(F.col("__text_score"), kind=T.DoubleType())
        if name == "hybrid_score":
            from ..operators.fusion import hybrid_score

            text = F.col("__text_score") if "__text_score" in env.vars else None
            if entity is None:  # the similarity itself
                return X(hybrid_score(self.ex(args[0], env, scope).col, text), kind=T.DoubleType())
            if text is None and "__vector_score" not in env.vars:
                raise CypherError("hybrid_score() needs text_match or a vector predicate in WHERE")
            weights = {"vector": 0.65, "text": 0.35} | (self.static(args[2]) if len(args) > 2 else {})
            v = F.col("__vector_score") if "__vector_score" in env.vars else F.lit(0.0)
            t = text / (1 + text) if text is not None else F.lit(0.0)
            return X(float(weights["vector"]) * F.coalesce(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)), F.lit(0.0)) + float(weights["text"]) * F.coalesce(t, F.lit(0.0)), kind=T.DoubleType())
        if name in FUSIONS:
            raise CypherError(f"{name}() stands in WITH, RETURN or ORDER BY")
        if name == "encrypted_match":
            from ..operators.mutate import token_of

            x, wanted = self.ex(args[0], env, scope), self.ex(args[1], env, scope)
            return X(x.col == (token_of(wanted.col, self.static(args[2])) if len(args) > 2 else wanted.col), kind=T.BooleanType())
        xs = self.many(args, env, scope)
        if name in ("length", "nodes", "relationships"):
            return self.ap({"length": lambda p: F.when(p.isNotNull(), F.size(p["rels"])).cast("long"), "nodes": lambda p: p["nodes"], "relationships": lambda p: p["rels"]}[name], xs[0])
        if name == "id" and S.is_int(env.type_of(xs[0])):
            return xs[0]  # startNode() and the like give ids
        if name == "keys":
            t = env.type_of(xs[0])
            return X(F.array(*[F.lit(k) for k in sorted(t.names)])) if isinstance(t, T.StructType) else self.ap(lambda m: F.sort_array(F.map_keys(m)), xs[0])
        if name == "properties":
            return xs[0]
        if name not in SCALAR:
            return X(F.lit(None), kind=T.NullType())  # unknown names are NULL
        types = [env.type_of(x) for x in xs]
        return self.ap(lambda *c: SCALAR[name](list(c), types), *xs)


def answer(tree: Query, out: Env) -> DataFrame | None:
    """The rows that a statement returns; a bare node is its id. None without RETURN."""
    last = tree.parts[0][-1]
    if isinstance(last, Procedure):
        return out.df.select(*[F.col(f"`{v.columns[0]}`").alias(n) for n, v in out.vars.items()])
    if not isinstance(last, Projection) or not last.final:
        return None
    return out.df.select(*[F.col(f"`{v.columns[0]}`").alias(n) for n, v in out.vars.items() if not n.startswith("__")])


def run(catalog: GraphCatalog, text: str, params: dict | None = None, strict_numbers: bool = False) -> DataFrame:
    """The rows of a read query."""
    tree = parse(text)
    rows = answer(tree, Compiler(catalog, params, strict_numbers).query(tree))
    if rows is None:
        raise CypherError("a read query ends with RETURN")
    return rows
