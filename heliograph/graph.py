"""Graph: the engine's entry point over a catalogue."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from .cypher import compiler
from .cypher.parser import Command, CypherError, Write, parse
from .cypher.writer import Writer
from .plans import advisor, commands
from .plans.catalog import GraphCatalog
from .plans.lineage import cut
from .streaming.changes import MAX_DEPTH, MAX_FANOUT

EXPLAIN = re.compile(r"\s*EXPLAIN(\s+SUGGEST)?\b", re.I)


@dataclass
class Written:
    """What a write leaves: the graph after it, its RETURN rows if it has any, and failed after-commit triggers."""

    graph: Graph
    rows: DataFrame | None
    dead_letters: list[dict] = field(default_factory=list)


class Graph:
    def __init__(self, catalog: GraphCatalog) -> None:
        self.catalog = catalog

    def query(self, text: str, strict_numbers: bool = False, **params) -> DataFrame:
        """Rows of a read query, of EXPLAIN [SUGGEST] or SHOW. Execution, with its first job, starts at the caller's action, but for many-hop traversal."""
        if m := EXPLAIN.match(text):
            plan = self.explain(text[m.end() :], bool(m[1]), **params)
            return self.catalog.spark.createDataFrame([(i, x) for i, x in enumerate(plan.split("\n"))], "line int, plan string").coalesce(1).orderBy("line")
        tree = parse(text)
        if len(tree.parts) == 1 and len(tree.parts[0]) == 1 and isinstance(c := tree.parts[0][0], Command) and c.kind == "show":
            return commands.execute(self.catalog, c)
        df = compiler.run(self.catalog, text, params, strict_numbers)
        self.catalog.log.append({"query": text, "fingerprint": advisor.fingerprint(text), "seconds": None})
        return df

    def rows(self, text: str, **params) -> list[Row]:
        """The query's rows on the driver; the advisor learns how long it ran."""
        began = time.time()
        out = self.query(text, **params).collect()
        if self.catalog.log and self.catalog.log[-1]["query"] == text:
            self.catalog.log[-1]["seconds"] = time.time() - began
        return out

    def explain(self, text: str, suggest: bool = True, **params) -> str:
        """The estimated cost, what the advisor finds, and Spark's physical plan."""
        df = compiler.run(self.catalog, text, params)
        plan = df._jdf.queryExecution()
        stats = plan.optimizedPlan().stats()
        rows = stats.rowCount()
        head = f"Cost: {stats.sizeInBytes()} bytes | Estimated rows: {rows.get() if rows.isDefined() else 'unknown'}\n"
        notes = "".join(f"-- {n['detector']}: {n['message']}\n" for n in advisor.suggestions(self.catalog, text)) if suggest else ""
        return head + notes + plan.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def write(self, text: str, strict_numbers: bool = False, **params) -> Written:
        """The graph after the statement; this one stays as it is.

        BEFORE COMMIT triggers run on the new tables, and an error of theirs is one of the statement; AFTER COMMIT
        triggers run next, each on what the one before it leaves, and a failure changes nothing.
        """
        tree = parse(text)
        if len(tree.parts) == 1 and len(tree.parts[0]) == 1 and isinstance(c := tree.parts[0][0], Command):
            catalog = self.catalog.copy()
            return Written(Graph(catalog), commands.execute(catalog, c))
        writer = Writer(self.catalog, params, strict_numbers)
        rows = compiler.answer(tree, writer.query(tree))
        after = self._triggered(writer, "before", params)
        out = Written(Graph(writer.catalog), rows)
        for t in after:
            self._after(out, t, params)
        self.catalog.log.append({"query": text, "fingerprint": advisor.fingerprint(text), "seconds": None})
        return out

    def _fired(self, catalog: GraphCatalog, touched: list, timing: str) -> list[dict]:
        events = set(touched)
        kind = lambda t: "edge" if t["edge"] else "node"
        return [t for _, t in sorted(catalog.triggers.items()) if t["enabled"] and t["timing"] == timing and any((kind(t), t["on"], e) in events for e in t["events"])]

    def _triggered(self, writer: Writer, timing: str, params: dict) -> list[dict]:
        """Runs triggers level by level; gives the after-commit triggers that all changes call for."""
        now, everything, depth = list(writer.touched), list(writer.touched), 0
        while fired := self._fired(writer.catalog, now, timing):
            depth += 1
            if depth > min(t["depth"] or MAX_DEPTH for t in fired) or len(fired) > min(t["fanout"] or MAX_FANOUT for t in fired):
                raise CypherError("a trigger's cascade went beyond its limits")
            writer.touched = []
            for t in fired:
                writer.query(parse(t["body"]))
            now = writer.touched
            everything += now
        return self._fired(writer.catalog, everything, "after")

    def _after(self, out: Written, t: dict, params: dict) -> None:
        error = t["on_error"]
        for attempt in range(error.get("attempts", 0) + 1):
            try:
                writer = Writer(out.graph.catalog, params)
                writer.query(parse(t["body"]))
                out.graph = Graph(writer.catalog)
                return
            except Exception as e:  # noqa: BLE001  whatever the body raises is the dead letter's reason
                reason = str(e)[:500]
                time.sleep(error.get("backoff_ms", 0) / 1000 * (attempt < error.get("attempts", 0)))
        out.dead_letters.append({"trigger": t["name"], "error": reason})

    def settled(self) -> Graph:
        """The same graph with every table kept under spark.checkpoint.dir, so that many writes in a row stay short plans."""
        from dataclasses import replace

        catalog = self.catalog.copy()
        for tables in (catalog.nodes, catalog.edges):
            for name, t in tables.items():
                tables[name] = replace(t, df=cut(t.df))
        return Graph(catalog)


def is_write(text: str) -> bool:
    return any(isinstance(c, (Write, Command)) for part in parse(text).parts for c in part)
