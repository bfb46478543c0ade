"""Writes in query text: each clause gives the catalogue new node and edge tables.

Clauses run in order over the rows bound so far, as in reading. Rows are numbered once before a clause
changes anything, from a kept copy, so the new ids and the edges that name them agree, also after an
executor is lost; a later row's value wins where several rows set one property. Every table is
rewritten as a plan (join, union, anti-join), never row by row.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mutate
from ..operators.mutate import WriteError
from ..plans.catalog import EdgeTable, GraphCatalog, NodeTable
from ..plans.lineage import cut
from .compiler import Compiler, Env, Var
from .parser import CypherError, Match, Node, Path, Rel, Write

#: Node merges and clones that one statement may name; their ids reach the driver.
MOST_NAMED = 100_000


class Writer(Compiler):
    def __init__(self, catalog: GraphCatalog, params: dict | None = None, strict_numbers: bool = False) -> None:
        super().__init__(catalog.copy(), params, strict_numbers)
        self.touched: list[tuple[str, str, str]] = []  # (node or edge, label or type, create, update or delete)

    def clauses(self, clauses: list, env: Env) -> Env:
        for c in clauses:
            env = getattr(self, "do_" + c.kind)(c.what, env) if isinstance(c, Write) else super().clauses([c], env)
        return env

    # rows
    def fixed(self, env: Env) -> Env:
        """Its rows kept and numbered from 0 in `__i`, in the order that they have."""
        parts = cut(env.df.drop("__i").withColumn("__m", F.monotonically_increasing_id()))
        part = F.shiftright("__m", 33)
        w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        before = parts.groupBy(part.alias("__p")).agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before"))
        df = parts.join(F.broadcast(before), part == F.col("__p")).withColumn("__i", F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
        return replace(env, df=df.drop("__m", "__p", "__before"), vars=dict(env.vars), unit=False)

    def labels_of(self, v: Var) -> list[str]:
        return [v.label] if v.label is not None else [*self.catalog.nodes]

    def of_label(self, df: DataFrame, v: Var, label: str) -> DataFrame:
        c = v.columns[0]
        df = df.where(F.col(c).isNotNull())
        return df if v.label is not None else df.where(F.col(f"{c}____label") == label)

    def node_of(self, name: str, env: Env, kind: str = "node") -> Var:
        v = env.vars.get(name)
        if v is None or v.kind != kind:
            raise CypherError(f"{name} is not a bound {kind}")
        return v

    # tables
    def put_nodes(self, label: str, df: DataFrame, event: str) -> None:
        table = self.catalog.nodes.get(label)
        self.catalog.nodes[label] = replace(table, df=df) if table else NodeTable(label, df)
        self.touched.append(("node", label, event))

    def put_edges(self, type: str, df: DataFrame, event: str, source: str | None = None, target: str | None = None) -> None:
        table = self.catalog.edges.get(type)
        self.catalog.edges[type] = replace(table, df=df) if table else EdgeTable(type, df, source, target)
        self.touched.append(("edge", type, event))

    def checked(self, label: str, new: DataFrame) -> DataFrame:
        """Rows that go into a label's table, if its schema allows them."""
        table = self.catalog.nodes.get(label)
        if table is None or table.mode == "flexible":
            return new
        extra = [c for c in new.columns if c != "id" and c not in table.df.columns]
        if table.mode == "strict" and extra:
            raise WriteError(f"{label} has no properties {extra}")
        missing = [p for p in table.required if p not in table.defaults]
        broken = F.lit(False)
        for p in missing:
            broken |= F.col(p).isNull() if p in new.columns else F.lit(True)
        if missing and not new.where(broken).isEmpty():
            raise WriteError(f"{label} needs {missing}")
        return new

    def add_nodes(self, labels: list[str], new: DataFrame) -> None:
        for label in labels:
            table = self.catalog.nodes.get(label)
            new = self.checked(label, new)
            self.put_nodes(label, table.df.unionByName(new, allowMissingColumns=True) if table else new, "create")

    def next_id(self, labels: list[str]) -> int:
        return max([mutate.next_id(self.catalog.nodes[x].df) for x in labels if x in self.catalog.nodes], default=1)

    def add_edges(self, type: str, new: DataFrame, source: str | None, target: str | None) -> None:
        table = self.catalog.edges.get(type)
        if table is None:
            return self.put_edges(type, new.dropDuplicates(["src", "dst"]), "create", source, target)
        for mine, declared in ((source, table.source), (target, table.target)):
            if declared is not None and mine is not None and mine != declared:
                raise WriteError(f"{type} goes from {table.source} to {table.target}")
        if table.temporal:
            if "valid_from" not in new.columns:
                raise WriteError(f"{type} needs valid_from")
            return self.put_edges(type, table.df.unionByName(new, allowMissingColumns=True), "create")
        self.put_edges(type, mutate.create_edges(table.df, new), "create")

    def edges_about(self, label: str) -> mutate.Edges:
        return {t: (e.df, e.source in (label, None), e.target in (label, None)) for t, e in self.catalog.edges.items()}

    # CREATE
    def do_create(self, paths: list[Path], env: Env) -> Env:
        env = self.fixed(env)
        for p in paths:
            names = [n.var if n.var in env.vars else self.new_node(n, env) for n in p.nodes]
            for i, r in enumerate(p.rels):
                self.new_edge(r, names[i], names[i + 1], env)
        return env

    def bind(self, name: str, kind: str, columns: dict[str, Column], env: Env, label: str | None = None) -> Var:
        env.df = env.df.withColumns(columns)
        env.vars[name] = Var(kind, tuple(columns), label)
        return env.vars[name]

    def new_node(self, n: Node, env: Env) -> str:
        if not n.labels:
            raise WriteError("a new node has a label")
        name = n.var or self.new("n")
        props = {k: self.ex(e, env, {}).col for k, e in (n.props or {}).items()}
        first = self.next_id(n.labels)
        v = self.bind(name, "node", {name: F.col("__i") + F.lit(first), **{f"{name}__{k}": c for k, c in props.items()}, f"{name}____label": F.lit(n.labels[0])}, env, n.labels[0])
        self.add_nodes(n.labels, env.df.select(F.col(name).alias("id"), *[F.col(f"`{name}__{k}`").alias(k) for k in props]))
        return v.columns[0]

    def new_edge(self, r: Rel, left: str, right: str, env: Env, rows: Column | None = None) -> None:
        if len(r.types) != 1 or r.hops:
            raise WriteError("a new relationship has one type")
        a, b = (right, left) if r.direction == "in" else (left, right)
        ev, type = r.var or self.new("r"), r.types[0]
        props = {f"{ev}__{k}": self.ex(e, env, {}).col for k, e in (r.props or {}).items()}
        key = F.xxhash64(F.lit(type), F.col(a), F.col(b))
        self.bind(ev, "edge", {ev: key, f"{ev}____type": F.lit(type), f"{ev}____src": F.col(a), f"{ev}____tgt": F.col(b), **props}, env)
        new = env.df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        new = new if rows is None else new.where(rows)
        self.add_edges(type, new.select(F.col(a).alias("src"), F.col(b).alias("dst"), *[F.col(f"`{ev}__{k}`").alias(k) for k in r.props or {}]), env.vars[left if a == left else right].label, env.vars[right if b == right else left].label)

    # SET and REMOVE
    def do_set(self, what, env: Env) -> Env:
        items, skip = what
        return self.assigned(items, self.fixed(env), skip=skip)

    def old(self, v: Var, prop: str, env: Env) -> Column:
        c = f"{v.columns[0]}__{prop}"
        return F.col(f"`{c}`") if c in env.df.columns else F.lit(None)

    def give(self, v: Var, name: str, prop: str, value: Column, where: Column | None, env: Env) -> Var:
        c = f"{v.columns[0]}__{prop}"
        env.df = env.df.withColumn(c, value if where is None else F.when(where, value).otherwise(self.old(v, prop, env)))
        if c not in v.columns:
            v = replace(v, columns=(*v.columns, c))
            env.vars[name] = v
        return v

    def assigned(self, items: list, env: Env, where: Column | None = None, skip: bool = False) -> Env:
        """The rows with the new values, which go to the tables for rows where `where` holds."""
        changed: dict[str, dict[str, None]] = {}
        for item in items:
            name = item[2] if item[0] == "doc" else item[1]
            v = env.vars.get(name)
            if v is None or v.kind not in ("node", "edge"):
                raise CypherError(f"{name} is not a bound node or relationship")
            done = changed.setdefault(name, {})
            if item[0] == "label":
                for label in item[2]:
                    self.add_label(v, label, env, where)
            elif item[0] == "all":
                given = self.map_of(item[3], env)
                if item[2] == "=":
                    for c in v.columns:
                        if c.startswith(f"{v.columns[0]}__") and "____" not in c and (p := c[len(v.columns[0]) + 2 :]) not in given:
                            v = self.give(v, name, p, F.lit(None), where, env)
                            done[p] = None
                for p, value in given.items():
                    v = self.give(v, name, p, value, where, env)
                    done[p] = None
            else:
                path = item[3] if item[0] == "doc" else item[2]
                value = self.ex(item[4] if item[0] == "doc" else item[3], env, {}).col
                if item[0] == "doc":
                    at = self.old(v, path[0], env)
                    for part in path[1:]:
                        at = at[part]
                    value = {"doc_push": mutate.doc_push, "doc_pull": mutate.doc_pull, "doc_add_to_set": mutate.doc_add_to_set, "doc_inc": mutate.doc_inc}[item[1]](at, value)
                if len(path) > 1:
                    value = self.old(v, path[0], env).withField(".".join(f"`{x}`" for x in path[1:]), value)
                self.give(v, name, path[0], value, where, env)
                done[path[0]] = None
        for name, props in changed.items():
            if props:
                self.store(name, [*props], env, where, skip)
        return env

    def map_of(self, e, env: Env) -> dict[str, Column]:
        if e[0] == "map":
            return {k: self.ex(x, env, {}).col for k, x in e[1].items()}
        if e[0] == "param":
            return {k: self.python(x, env).col for k, x in (self.params.get(e[1]) or {}).items()}
        if e[0] == "var" and e[1] in env.vars and env.vars[e[1]].kind in ("node", "edge"):
            v = env.vars[e[1]]
            return {c[len(v.columns[0]) + 2 :]: F.col(f"`{c}`") for c in v.columns[1:] if "____" not in c}
        x = self.ex(e, env, {})
        t = env.type_of(x)
        if not isinstance(t, T.StructType):
            raise CypherError("properties are set from a map")
        return {k: x.col[k] for k in t.names}

    def store(self, name: str, props: list[str], env: Env, where: Column | None, skip: bool) -> None:
        v = env.vars[name]
        rows = env.df if where is None else env.df.where(where)
        new = F.max_by(F.struct(*[F.col(f"`{v.columns[0]}__{p}`").alias(p) for p in props]), F.col("__i")).alias("__v")
        if v.kind == "node":
            for label in self.labels_of(v):
                if label not in self.catalog.nodes:
                    continue
                table = self.catalog.nodes[label]
                got = self.of_label(rows, v, label).groupBy(F.col(v.columns[0]).alias("__x")).agg(new)
                got = self.allowed(table, got, props, skip)
                df = table.df
                df = df.join(got, df["id"] == got["__x"], "left").withColumn("__hit", F.col("__x").isNotNull())
                self.put_nodes(label, self.merged(df, table.df.columns, props), "update")
            return
        c = v.columns[0]
        for type in [t for t in self.catalog.edges]:
            mine = rows.where(F.col(f"{c}____type") == type)
            table = self.catalog.edges[type]
            got = mine.groupBy(F.col(f"{c}____src").alias("__x"), F.col(f"{c}____tgt").alias("__y")).agg(new)
            if len(self.catalog.edges) > 1 and got.isEmpty():
                continue
            df = table.df
            df = df.join(got, (df["src"] == got["__x"]) & (df["dst"] == got["__y"]), "left").withColumn("__hit", F.col("__x").isNotNull())
            self.put_edges(type, self.merged(df, table.df.columns, props), "update")

    def merged(self, df: DataFrame, columns: list[str], props: list[str]) -> DataFrame:
        out = [F.col(f"`{c}`") for c in columns if c not in props]
        value = lambda p: F.when(F.col("__hit"), F.col("__v")[p]).otherwise(F.col(f"`{p}`") if p in columns else F.lit(None)).alias(p)
        return df.select(*out, *map(value, props))

    def allowed(self, table: NodeTable, got: DataFrame, props: list[str], skip: bool) -> DataFrame:
        """The updates that the label's rules allow; others are left out with `skip`, else an error."""
        if table.mode == "strict" and (extra := [p for p in props if p not in table.properties]):
            raise WriteError(f"{table.label} has no properties {extra}")
        broken = F.lit(False)
        for p in set(props) & set(table.required):
            broken |= F.col("__v")[p].isNull()
        for p in set(props) & set(table.unique):
            taken = table.df.select(F.col(p).alias("__t"), F.col("id").alias("__o")).where(F.col("__t").isNotNull())
            twice = F.count("*").over(Window.partitionBy(F.col("__v")[p])) > 1
            got = got.withColumn("__twice", F.col("__v")[p].isNotNull() & twice)
            clash = got.join(taken, (F.col("__v")[p] == F.col("__t")) & (F.col("__x") != F.col("__o"))).select(F.col("__x").alias("__z")).distinct()
            got = got.join(clash, F.col("__x") == F.col("__z"), "left").withColumn("__bad_" + p, F.col("__twice") | F.col("__z").isNotNull()).drop("__z", "__twice")
            broken |= F.col("__bad_" + p)
        if not skip and (set(props) & {*table.required, *table.unique}) and not got.where(broken).isEmpty():
            raise WriteError(f"{table.label} has rules for {sorted(set(props) & {*table.required, *table.unique})}")
        return got.where(~broken).select("__x", "__v")

    def add_label(self, v: Var, label: str, env: Env, where: Column | None) -> None:
        """The nodes in the label's table too, under their ids and with their properties."""
        c = v.columns[0]
        own = [x for x in v.columns[1:] if "____" not in x]
        rows = (env.df if where is None else env.df.where(where)).where(F.col(c).isNotNull())
        new = rows.select(F.col(c).alias("id"), *[F.col(f"`{x}`").alias(x[len(c) + 2 :]) for x in own]).dropDuplicates(["id"])
        if label in self.catalog.nodes:
            new = new.join(self.catalog.nodes[label].df.select("id"), "id", "left_anti")
        self.add_nodes([label], new)

    def do_remove(self, items: list, env: Env) -> Env:
        env = self.fixed(env)
        env = self.assigned([("prop", x[1], x[2], ("lit", None)) for x in items if x[0] == "prop"], env)
        for _, name, labels in (x for x in items if x[0] == "label"):
            v = self.node_of(name, env)
            for label in labels:
                if label in self.catalog.nodes:
                    gone = env.df.where(F.col(v.columns[0]).isNotNull()).select(F.col(v.columns[0]).alias("id")).distinct()
                    self.put_nodes(label, self.catalog.nodes[label].df.join(gone, "id", "left_anti"), "update")
        return env

    # DELETE
    def do_delete(self, what, env: Env) -> Env:
        names, detach = what
        env = self.fixed(env)
        for name in names:
            if name not in env.vars or env.vars[name].kind not in ("node", "edge"):
                raise CypherError(f"{name} is not a bound node or relationship")
        for name in (n for n in names if env.vars[n].kind == "edge"):
            for type in [*self.catalog.edges]:
                gone = env.df.where(F.col(f"{name}____type") == type).select(F.col(f"{name}____src").alias("src"), F.col(f"{name}____tgt").alias("dst")).distinct()
                self.put_edges(type, self.catalog.edges[type].df.join(gone, ["src", "dst"], "left_anti"), "delete")
        for name in (n for n in names if env.vars[n].kind == "node"):
            v = env.vars[name]
            for label in self.labels_of(v):
                if label in self.catalog.nodes:
                    self.drop_nodes(label, self.of_label(env.df, v, label).select(F.col(v.columns[0]).alias("id")), detach)
        return env

    def drop_nodes(self, label: str, ids: DataFrame, detach: bool) -> None:
        about = {t: x for t, x in self.edges_about(label).items() if x[1] or x[2]}
        nodes, edges = mutate.delete_nodes(self.catalog.nodes[label].df, about, ids, detach)
        self.put_nodes(label, nodes, "delete")
        for t, df in edges.items():
            self.put_edges(t, df, "delete")

    # MERGE
    def do_merge(self, what, env: Env) -> Env:
        p, hit, miss, every = what
        env = self.fixed(env)
        made = None
        for n in p.nodes:
            if n.var not in env.vars:
                env, n.var = self.merge_node(n, env, one=bool(p.rels) and not every)
                made = F.col("__made")
        for i, r in enumerate(p.rels):
            env = self.merge_edge(r, p.nodes[i].var, p.nodes[i + 1].var, env)
            made = F.col("__made")
        if made is None:
            return env
        env = self.assigned(hit, env, where=~made)
        env = self.assigned(miss, env, where=made)
        env.df = env.df.drop("__made")
        return env

    def merge_node(self, n: Node, env: Env, one: bool) -> tuple[Env, str]:
        """Rows with the nodes that match, or with a new one; `__made` says which. one: several matches for a row are an error."""
        if not n.labels:
            raise WriteError("a merged node has a label")
        name, label = n.var or self.new("n"), n.labels[0]
        keys = {k: f"__key_{k}" for k in n.props or {}}
        left = env.df.drop("__made").withColumns({keys[k]: self.ex(e, env, {}).col for k, e in (n.props or {}).items()})
        right, v = self.scan(n, name)
        on = F.lit(True)
        for k in keys:
            on &= left[keys[k]] == right[f"{name}__{k}"] if f"{name}__{k}" in right.columns else F.lit(False)
        both = cut(left.join(right, on, "left"))
        if one and not both.groupBy("__i").count().where("count > 1").isEmpty():
            raise WriteError(f"several nodes match ({name}:{label}); MERGE ALL takes each")
        wanted = both.where(F.col(name).isNull())
        new = (wanted.groupBy(*keys.values()) if keys else wanted.limit(1).groupBy(F.lit(1).alias("__all"))).agg(F.min("__i").alias("__first"))
        new = cut(mutate.with_ids(new, self.next_id(n.labels), ["__first"]))
        self.add_nodes(n.labels, new.select("id", *[F.col(c).alias(k) for k, c in keys.items()]))
        ids = new.select(F.col("id").alias("__new"), *[F.col(c).alias(f"__as{c}") for c in keys.values()])
        same = F.col(name).isNull()
        for c in keys.values():
            same &= F.col(c).eqNullSafe(F.col(f"__as{c}"))
        df = both.join(ids, same, "left").withColumn("__made", F.col(name).isNull()).withColumn(name, F.coalesce(name, "__new"))
        for k, c in keys.items():
            x = f"{name}__{k}"
            df = df.withColumn(x, F.coalesce(F.col(f"`{x}`"), F.col(c)) if x in df.columns else F.col(c))
            if x not in v.columns:
                v = replace(v, columns=(*v.columns, x))
        df = df.withColumn(f"{name}____label", F.coalesce(f"{name}____label", F.lit(label)))
        return self.fixed(replace(env, df=df.drop("__new", *keys.values(), *[f"__as{c}" for c in keys.values()]), vars={**env.vars, name: v})), name

    def merge_edge(self, r: Rel, left: str, right: str, env: Env) -> Env:
        if len(r.types) != 1 or r.hops:
            raise WriteError("a merged relationship has one type")
        ev, type = r.var or self.new("r"), r.types[0]
        a, b = (right, left) if r.direction == "in" else (left, right)
        props = {k: self.ex(e, env, {}).col for k, e in (r.props or {}).items()}
        given = {f"__key_{k}": c for k, c in props.items()}
        rows = env.df.drop("__made").withColumns(given) if given else env.df.drop("__made")
        found = rows.withColumn("__made", F.lit(True))
        own: list[str] = []
        if type in self.catalog.edges:
            edges = self.catalog.edges_of([type], "both" if r.direction == "both" else "out")
            own = [c for c in edges.columns if not c.startswith("__") and c not in ("src", "dst")]
            e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("__a").alias("__ea"), F.col("__b").alias("__eb"), *[F.col(f"`{c}`").alias(f"{ev}__{c}") for c in own])
            on = (rows[a] == e["__s"]) & (rows[b] == e["__d"])
            for k in props:
                on &= rows[f"__key_{k}"] == e[f"{ev}__{k}"] if k in own else F.lit(False)
            found = rows.join(e, on, "left").withColumn("__made", F.col("__s").isNull())
        else:
            found = found.withColumns({"__ea": F.lit(None).cast("long"), "__eb": F.lit(None).cast("long")})
        for k in props:
            c = f"{ev}__{k}"
            found = found.withColumn(c, F.when(F.col("__made"), F.col(f"__key_{k}")).otherwise(F.col(f"`{c}`")) if c in found.columns else F.col(f"__key_{k}"))
        src, dst = F.coalesce(F.col("__ea"), F.col(a)), F.coalesce(F.col("__eb"), F.col(b))
        found = found.withColumns({f"{ev}____type": F.lit(type), f"{ev}____src": src, f"{ev}____tgt": dst, ev: F.xxhash64(F.lit(type), src, dst)})
        columns = (ev, f"{ev}____type", f"{ev}____src", f"{ev}____tgt", *dict.fromkeys(f"{ev}__{k}" for k in [*own, *props]))
        out = self.fixed(replace(env, df=found.drop("__s", "__d", "__ea", "__eb", *given), vars={**env.vars, ev: Var("edge", columns)}))
        new = out.df.where(F.col("__made") & F.col(a).isNotNull() & F.col(b).isNotNull())
        self.add_edges(type, new.select(F.col(a).alias("src"), F.col(b).alias("dst"), *[F.col(f"`{ev}__{k}`").alias(k) for k in props]), env.vars[left if a == left else right].label, env.vars[right if b == right else left].label)
        return out

    def do_upsert(self, what, env: Env) -> Env:
        """For each row: what matches is updated; where nothing does, the patterns are created."""
        p, hit, miss = what
        env = self.fixed(env)
        found = self.match(Match([p]), replace(env, vars=dict(env.vars)))
        found = replace(found, df=cut(found.df))
        rest = replace(env, df=env.df.join(found.df.select("__i").distinct(), "__i", "left_anti"))
        out = self.assigned(hit, self.fixed(found)) if hit else found
        if miss:
            made = self.do_create(miss, rest)
            # What the pattern binds is null in rows that were created without it.
            out = replace(out, df=out.df.unionByName(made.df, allowMissingColumns=True))
        return out

    def do_foreach(self, what, env: Env) -> Env:
        var, items, body = what
        env = self.fixed(env)
        x = self.ex(items, env, {})
        inner = replace(env, df=env.df.withColumn(var, F.explode(x.col)), vars={**env.vars, var: Var("value", (var,))})
        self.clauses(body, inner)
        return env

    # refactoring
    def named(self, df: DataFrame, *columns: Column) -> list[tuple]:
        got = df.select(*columns).distinct().limit(MOST_NAMED + 1).collect()
        if len(got) > MOST_NAMED:
            raise WriteError(f"more than {MOST_NAMED} nodes in one statement")
        return sorted(tuple(r) for r in got)

    def single_label(self, v: Var) -> str:
        if v.label is None or v.label not in self.catalog.nodes:
            raise WriteError("the node's label must be given")
        return v.label

    def put_all(self, label: str, nodes: DataFrame, edges: dict[str, DataFrame], event: str = "update") -> None:
        self.put_nodes(label, nodes, event)
        for t, df in edges.items():
            self.put_edges(t, df, event)

    def constants(self, items: list, env: Env) -> dict[str, Column]:
        """Values of SET items as columns over the node's own table."""
        out = {}
        for item in items:
            if item[0] != "prop" or len(item[2]) > 1:
                raise WriteError("only properties can be set here")
            out[item[2][0]] = self.ex(item[3], Env(env.df, {}), {}).col
        return out

    def do_merge_nodes(self, what: dict, env: Env) -> Env:
        env = self.fixed(env)
        target = what["into"]
        other = next(n for n in what["nodes"] if n != target)
        a, b = self.node_of(target, env), self.node_of(other, env)
        label = self.single_label(a)
        if self.single_label(b) != label:
            raise WriteError("merged nodes have one label")
        pairs = self.named(env.df.where(F.col(target) != F.col(other)), F.col(other), F.col(target))
        into = dict(pairs)
        if len(into) < len(pairs) or set(into) & set(into.values()):
            raise WriteError("a node is merged into one other, which stays")
        about = {t: x for t, x in self.edges_about(label).items() if x[1] or x[2]}
        if not what["edges"]:  # edges of the merged nodes go with them
            gone = self.catalog.spark.createDataFrame([(k,) for k in into], "id long")
            about = {t: (df, *about[t][1:]) for t, df in mutate.delete_nodes(self.catalog.nodes[label].df, about, gone, True)[1].items()}
        nodes, edges = mutate.merge_nodes(self.catalog.nodes[label].df, about, into, what["keep"], what["duplicates"])
        if what["values"]:
            values = self.constants(what["values"], env)
            nodes = mutate.set_properties(nodes, F.col("id").isin([*set(into.values())]), values)
        self.put_all(label, nodes, edges)
        return env

    def do_clone_node(self, what: dict, env: Env) -> Env:
        env = self.fixed(env)
        v = self.node_of(what["node"], env)
        label = self.single_label(v)
        ids = [r[0] for r in self.named(env.df.where(F.col(what["node"]).isNotNull()), F.col(what["node"]))]
        first, table = self.next_id([label]), self.catalog.nodes[label].df
        if what["as_of"] is not None:
            old = self.catalog.as_of(self.instant(what["as_of"])).nodes[label].df.where(F.col("id").isin(ids))
            table = table.where(~F.col("id").isin(ids)).unionByName(old)
        values = self.constants(what["values"], env)
        nodes, edges = mutate.clone_nodes(table, self.edges_about(label), ids, values, what["edges"])
        nodes = self.catalog.nodes[label].df.unionByName(nodes.where(F.col("id") >= first), allowMissingColumns=True)
        self.put_all(label, nodes, edges if what["edges"] else {}, "create")
        pairs = self.catalog.spark.createDataFrame([(old, first + i) for i, old in enumerate(ids)], "__old long, __new long")
        copies = nodes.where(F.col("id") >= first)
        name = what["clone"]
        right = copies.select(F.col("id").alias(name), *[F.col(f"`{c}`").alias(f"{name}__{c}") for c in copies.columns if c != "id"], F.lit(label).alias(f"{name}____label"))
        env.df = env.df.join(F.broadcast(pairs), F.col(what["node"]) == F.col("__old"), "left").join(right, F.col("__new") == F.col(name), "left").drop("__old", "__new")
        env.vars[name] = Var("node", tuple([name, *[c for c in right.columns if c != name]]), label)
        return env

    def do_redirect_edges(self, what: dict, env: Env) -> Env:
        env = self.fixed(env)
        self.redirect(what, env)
        return env

    def redirect(self, what: dict, env: Env) -> None:
        a, b = self.node_of(what["from"], env), self.node_of(what["to"], env)
        moves = env.df.where(F.col(what["from"]).isNotNull() & F.col(what["to"]).isNotNull()).groupBy(F.col(what["from"]).alias("__old")).agg(F.min(what["to"]).alias("__new"))
        for t, e in [*self.catalog.edges.items()]:
            if what["types"] is not None and t not in what["types"]:
                continue
            df, moved = e.df, False
            for end, ways, declared, v in (("src", ("out", "both"), e.source, a), ("dst", ("in", "both"), e.target, a)):
                if what["direction"] in ways and declared in (v.label, None):
                    df = df.join(moves, df[end] == moves["__old"], "left").withColumn(end, F.coalesce("__new", end)).drop("__old", "__new")
                    moved = True
            if moved:
                if b.label is not None and a.label != b.label:
                    # Ends of another label no longer are what the type declares.
                    self.catalog.edges[t] = replace(e, source=None if e.source == a.label else e.source, target=None if e.target == a.label else e.target)
                self.put_edges(t, df if e.temporal else df.select(e.df.columns).dropDuplicates(["src", "dst"]), "update")

    def do_detach_document(self, what: dict, env: Env) -> Env:
        """A nested document becomes a node with an edge, and the property goes."""
        if len(what["path"]) > 1:
            raise WriteError("only a property of the node itself can be detached")
        env = self.fixed(env)
        v, prop = self.node_of(what["var"], env), what["path"][0]
        p = what["pattern"]
        fresh = next(n for n in p.nodes if n.var != what["var"])
        if f"{v.columns[0]}__{prop}" not in env.df.columns:
            raise WriteError(f"{what['var']} has no {prop}")
        kind = env.df.schema[f"{v.columns[0]}__{prop}"].dataType
        if not isinstance(kind, T.StructType) or not fresh.labels:
            raise WriteError(f"{prop} is no document, or the new node has no label")
        rows = replace(env, df=env.df.where(F.col(f"`{v.columns[0]}__{prop}`").isNotNull()), vars=dict(env.vars))
        node = Node(fresh.var or self.new("n"), fresh.labels, {k: ("prop", ("prop", ("var", what["var"]), prop), k) for k in kind.names})
        rel = p.rels[0] if p.rels[0].types else replace(p.rels[0], types=[mutate.has_type(prop)])
        made = self.do_create([Path(None, False, [node if n is fresh else n for n in p.nodes], [rel])], rows)
        self.assigned([("prop", what["var"], [prop], ("lit", None))], self.fixed(made))
        if what["transfer"]:
            self.redirect(what["transfer"], made)
        return made

    def do_attach_document(self, what: dict, env: Env) -> Env:
        """The node at the end of the edge becomes a nested document of the other, and goes with its edges."""
        if len(what["path"]) > 1:
            raise WriteError("only a property of the node itself can take a document")
        p, prop = what["pattern"], what["path"][0]
        found = self.match(Match([p]), replace(env, vars=dict(env.vars)))
        found = self.fixed(found)
        taken = next(n.var for n in p.nodes if n.var != what["var"])
        v, d = self.node_of(what["var"], found), self.node_of(taken, found)
        if not found.df.groupBy(v.columns[0]).count().where("count > 1").isEmpty():
            raise WriteError("a node has more than one document to attach")
        there = f"{v.columns[0]}__{prop}"
        if there in found.df.columns and not what["replace"] and not found.df.where(F.col(f"`{there}`").isNotNull()).isEmpty():
            raise WriteError(f"{prop} is there already; ON CONFLICT REPLACE overwrites it")
        own = [c for c in d.columns[1:] if "____" not in c]
        nested = F.struct(*[F.col(f"`{c}`").alias(c[len(taken) + 2 :]) for c in own])
        if there in found.df.columns and found.df.schema[there].dataType != found.df.select(nested).schema[0].dataType:
            found.df = found.df.drop(there)
            table = self.catalog.nodes[self.single_label(v)]
            self.put_nodes(table.label, table.df.drop(prop), "update")
        self.give(v, what["var"], prop, nested, None, found)
        self.store(what["var"], [prop], found, None, False)
        if what["transfer"]:
            self.redirect(what["transfer"], found)
        label = self.single_label(d)
        ids = found.df.select(F.col(taken).alias("id"))
        if what["fail"]:
            type = p.rels[0].types[0] if p.rels[0].types else None
            for t, (e, source, target) in self.edges_about(label).items():
                for end, mine in (("src", source), ("dst", target)):
                    if t != type and mine and not e.join(ids, e[end] == ids["id"], "left_semi").isEmpty():
                        raise WriteError(f"{t} edges remain")
        self.drop_nodes(label, ids.distinct(), True)
        return found
