"""Operators against small fixtures and plain Python."""

import random
from datetime import datetime

import pytest
from heliograph.graph import Graph
from heliograph.operators import decay, fusion, mutate, spatial, text, timeseries, traverse
from heliograph.operators.traverse import MAX_HOPS, shortest_path, var_length
from heliograph.plans.catalog import GraphCatalog
from heliograph.plans.joins import FEW
from heliograph.sources import dumps
from heliograph.streaming import changes
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def random_graph(spark):
    r = random.Random(7)
    pairs = sorted({(r.randrange(14), r.randrange(14)) for _ in range(30)})
    g = GraphCatalog(spark)
    g.edge("E", spark.createDataFrame(pairs, "src long, dst long"))
    return g, pairs


@pytest.mark.parametrize("low,high", [(1, 2), (0, 2), (2, 3)])
def test_trails_against_search(spark, random_graph, low, high):
    g, pairs = random_graph
    want = []

    def walk(start, at, used):
        if len(used) >= low:
            want.append((start, at))
        if len(used) < high:
            for e in pairs:
                if e[0] == at and e not in used:
                    walk(start, e[1], [*used, e])

    for s in range(3):
        walk(s, s, [])
    seeds = spark.createDataFrame([(i,) for i in range(3)], "a long")
    assert rows(var_length(seeds, "a", g.edges_of(["E"], "out"), low, high, "b").select("a", "b")) == sorted(want)
    assert rows(var_length(seeds, "a", g.edges_of(["E"], "out"), low, high, "b", distinct=True).select("a", "b")) == sorted(set(want))


def test_shortest_against_search(spark, random_graph):
    g, pairs = random_graph
    seeds = spark.createDataFrame([(a, b) for a in range(4) for b in range(14)], "a long, b long")
    got = {(r["a"], r["b"]): r["n"] for r in shortest_path(seeds, "a", "b", g.edges_of(["E"], "out"), "p").select("a", "b", F.when(F.col("p").isNotNull(), F.size("p.rels")).alias("n")).collect()}
    for a in range(4):
        dist, front = {a: 0}, {a}
        for h in range(1, MAX_HOPS + 1):
            front = {d for s, d in pairs if s in front} - set(dist)
            dist |= dict.fromkeys(front, h)
        for b in range(14):
            assert got[a, b] == dist.get(b)


MANY = 2 * FEW


@pytest.fixture
def tree(spark, monkeypatch):
    """A tree of MANY parts, each under the part of half its id, and the plans of all frames that a traversal keeps."""
    g = GraphCatalog(spark)
    g.node("P", spark.range(1, MANY).withColumn("odd", F.col("id") % 2))
    g.edge("UP", spark.range(2, MANY).select(F.col("id").alias("src"), F.expr("id div 2").alias("dst")), "src", "dst", "P", "P")
    plans, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (plans.append(plan_of(df)), cut(df))[1])
    return Graph(g), plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shortest_path_copies_no_large_table(spark, tree):
    g, plans = tree
    df = g.query("MATCH (a:P)-[:UP*1..2]->(b:P) MATCH p = shortestPath((a)-[:UP*..2]-(b)) RETURN id(a) AS a, id(b) AS b, length(p) AS hops")
    assert len(plans) > 3 and not [x for x in [*plans, plan_of(df)] if "Broadcast" in x]
    assert rows(df) == sorted((a, a >> h, h) for a in range(1, MANY) for h in (1, 2) if a >> h)


@pytest.mark.parametrize(
    "query,want",
    [
        ("MATCH (p:P)-[:UP*2..4]->(q:P) RETURN id(p) AS p, id(q) AS q", [(p, p >> h) for p in range(1, MANY) for h in (2, 3, 4) if p >> h]),
        ("MATCH (p:P {odd: 1})-[:UP*1..3]->(q:P) RETURN count(DISTINCT q) AS n", [(MANY // 2 - 1,)]),
        ("MATCH p = (a:P)-[:UP*1..2]->(b:P) RETURN id(a) AS a, length(p) AS hops", [(a, h) for a in range(1, MANY) for h in (1, 2) if a >> h]),
        ("MATCH (p:P) WHERE EXISTS { (p)<-[:UP*1..2]-(q:P) } RETURN id(p) AS p", [(p,) for p in range(1, MANY // 2)]),
    ],
)
def test_many_hops_copy_no_large_table(tree, query, want):
    g, plans = tree
    df = g.query(query)
    assert not [x for x in [*plans, plan_of(df)] if "Broadcast" in x]
    assert rows(df) == sorted(want)


def test_text_queries(spark):
    docs = spark.createDataFrame([(1, "Rust graph database"), (2, "Python machine learning"), (3, "Rust web framework graph"), (4, None)], "id long, text string")
    ids = lambda q, **k: {r["id"] for r in text.search(docs, q, **k).collect()}
    assert ids("graph") == {1, 3} and ids("graph python") == {1, 2, 3} and ids("rust AND database") == {1}
    assert ids("rust NOT web") == {1} and ids('"graph database"') == {1} and ids("data*") == {1} and ids("") == set()
    assert ids("grahp") == set() and ids("grph", fuzzy=True) == {1, 3} and ids("+rust -graph") == set()
    s = {r["id"]: r["score"] for r in text.search(docs, "rust^3 graph").collect()}
    assert s[1] > s[3] > 0
    assert docs.select(text.snippet(F.col("text"), "graph").alias("s")).first()["s"] == "Rust <b>graph</b> database"


def test_fusion(spark):
    df = spark.createDataFrame([(1, 0.9, None), (2, 0.9, 3.0), (3, 0.1, 5.0)], "id long, a double, b double")
    r = {x["id"]: x["rrf_score"] for x in fusion.rrf(df, ["a", "b"]).collect()}
    assert r[1] == pytest.approx(1 / 61 + 1 / 63) and r[2] == pytest.approx(1 / 61 + 1 / 62) and r[3] == pytest.approx(1 / 63 + 1 / 61)
    c = {x["id"]: x["cc_score"] for x in fusion.convex(df, {"a": 0.5, "b": 0.5}).collect()}
    assert c == pytest.approx({1: 0.5, 2: 0.5, 3: 0.5})
    d = {x["id"]: x["dbsf_score"] for x in fusion.dbsf(df.withColumn("c", F.lit(1.0)), {"c": 1.0}).collect()}
    assert d == {1: 0.0, 2: 0.0, 3: 0.0}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    chunks = spark.createDataFrame([(1, 1.0), (1, 0.8), (1, 0.6), (2, 0.0), (2, -1.0), (2, -0.707)], "id long, sim double")
    s = {x["id"]: x["doc_score"] for x in fusion.doc_score(docs, chunks, "sim").collect()}
    assert s[1] == pytest.approx(0.94) and s[3] == 0.0 and s[2] == pytest.approx(0.3 * -1.707 / 3)


def test_spatial(spark):
    p = spark.createDataFrame([(1, 40.7128, -74.006), (2, 51.5074, -0.1278), (3, 10.0, 179.5), (4, None, None)], "id long, latitude double, longitude double")
    assert [r["id"] for r in spatial.within_radius(p, 40.7, -74.0, 50_000).collect()] == [1]
    assert [r["id"] for r in spatial.within_box(p, 0, 170, 20, -170).collect()] == [3]
    assert [r["id"] for r in spatial.nearest(p.where("id < 4"), 50, 0, 2).collect()] == [2, 1]
    q = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, "xyz")])
    one = spark.range(1).select(spatial.distance(q(0, 0, 0), q(3, 4, 0), spatial.CARTESIAN), spatial.distance(q(0, 0, 0), q(2, 3, 6), spatial.CARTESIAN_3D), spatial.distance(q(0, 0, 3), q(0, 0, 7), spatial.WGS84_3D)).first()
    assert tuple(one) == (5.0, 7.0, 4.0)


def test_time_series(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([("a", at(1), at(1), 1.0), ("a", at(1, 30), at(2, 30), 3.0), ("a", at(0, 10), at(9), 5.0), ("b", at(1), at(1), 7.0)], "meta string, ts timestamp, ingestion_ts timestamp, value double")
    b = timeseries.buckets(df, ["value"]).orderBy("meta", "bucket").collect()
    assert [(r["meta"], r["n"], r["value_min"], r["value_max"]) for r in b] == [("a", 1, 5.0, 5.0), ("a", 2, 1.0, 3.0), ("b", 1, 7.0, 7.0)]
    assert [r["tier"] for r in timeseries.late_tiers(df).orderBy("value").collect()] == [1, 2, 3, 1]
    latest = timeseries.as_of(df, F.lit(at(3)), by=["meta"], order=["ingestion_ts"], keep=["value"])
    assert rows(latest) == [("a", 3.0, 2), ("b", 7.0, 1)]
    m = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2}), ("a", 3, {"x": 1, "y": 1})], "meta string, ts long, f map<string,int>")
    assert [r["bucket"] for r in timeseries.schema_rollover(m, "f", order=["ts"]).orderBy("ts").collect()] == [0, 0, 1]
    v = spark.createDataFrame([(1, 0, 5), (2, 3, None)], "id int, created_at int, deleted_at int")
    assert [r["id"] for r in timeseries.visible(v).collect()] == [2] and [r["id"] for r in timeseries.visible(v, F.lit(4)).orderBy("id").collect()] == [1, 2]


def test_decay(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (None,)], "age double")
    a = F.col("age")
    got = df.select(decay.linear(a, 100), decay.exponential(a, 50), decay.power_law(a, 50, 1), decay.step(a, [(10, 1.0), (60, 0.5)])).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.5), (0.0, 0.25, pytest.approx(1 / 3), 0.0), (None, None, None, None)]


def test_reaping_by_scope(spark):
    """Expired: before the cutoff, not at it; rows without an anchor stay."""
    at = lambda d: datetime(2024, 1, d)
    n = spark.createDataFrame([(1, at(1), "a"), (2, at(5), "b"), (3, None, "c"), (4, at(9), None)], "id long, at timestamp, doc string")
    e = spark.createDataFrame([(1, 2), (2, 4), (4, 1)], "src long, dst long")
    now, day = F.lit("2024-01-10").cast("timestamp"), 86400
    ids = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    nodes, edges = decay.reap(n, {"E": (e, True, True)}, "at", 5 * day, now)
    assert ids(nodes, "id") == [(2,), (3,), (4,)] and ids(edges["E"], "src", "dst") == [(2, 4)]
    nodes, edges = decay.reap(n, {"E": (e, True, True)}, "at", 5 * day, now, "field")
    assert ids(nodes.where("at IS NULL"), "id") == [(1,), (3,)] and edges["E"].count() == 3
    nodes, _ = decay.reap(n, {}, "at", 5 * day, now, "subtree", "doc")
    assert ids(nodes, "id", "doc") == [(1, None), (2, "b"), (3, "c"), (4, None)] and nodes.where("at IS NULL").count() == 1
    assert ids(decay.reap(nodes, {}, "at", 5 * day, now, "subtree", "doc")[0], "id", "doc") == ids(nodes, "id", "doc")
    assert decay.reap(n, {}, "at", 5 * day, now, "subtree", "other")[0].columns == n.columns
    with pytest.raises(ValueError):
        decay.reap(n, {}, "at", day, now, "label")


def test_writes(spark):
    nodes = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id long, name string, p string")
    edges = spark.createDataFrame([(1, 2, "e"), (2, 3, None), (3, 1, "g")], "src long, dst long, w string")
    e = {"R": (edges, True, True)}
    new = mutate.create_nodes(nodes, spark.createDataFrame([("z",), ("d",)], "name string"), ["name"])
    assert rows(new.select("id", "name"))[3:] == [(4, "d"), (5, "z")]
    assert mutate.create_edges(edges, spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "src long, dst long")).count() == 4
    with pytest.raises(mutate.WriteError):
        mutate.delete_nodes(nodes, e, nodes.where("id = 1").select("id"))
    left, out = mutate.delete_nodes(nodes, e, nodes.where("id = 1").select("id"), detach=True)
    assert rows(left.select("id")) == [(2,), (3,)] and rows(out["R"].select("src", "dst")) == [(2, 3)]
    once = mutate.merge(nodes, spark.createDataFrame([("a",), ("q",), ("q",)], "name string"), ["name"], on_match={"p": F.lit("hit")}, on_create={"p": F.lit("new")})
    assert rows(once.where("id in (1, 4)")) == [(1, "a", "hit"), (4, "q", "new")]
    assert rows(mutate.merge(once, spark.createDataFrame([("a",), ("q",)], "name string"), ["name"]).select("id", "name")) == rows(once.select("id", "name"))
    merged, out = mutate.merge_nodes(nodes, e, {2: 1}, keep="coalesce")
    assert rows(merged) == [(1, "a", "x"), (3, "c", "y")] and rows(out["R"]) == [(1, 1, "e"), (1, 3, None), (3, 1, "g")]
    copy, out = mutate.clone_nodes(nodes, e, [2], {"name": F.lit("copy")}, with_edges=True)
    assert rows(copy.where("id > 3")) == [(4, "copy", "x")] and rows(out["R"].where("src = 4 or dst = 4").select("src", "dst")) == [(1, 4), (4, 3)]
    assert rows(mutate.redirect_edges(edges, 1, 3, "out").select("src", "dst")) == [(2, 3), (3, 1), (3, 2)]
    assert mutate.has_type("homeAddress") == "HAS_HOME_ADDRESS"
    nested = nodes.withColumn("doc", F.when(F.col("id") > 1, F.struct(F.col("name").alias("n"))))
    bare, docs, link = mutate.detach_document(nested, "doc")
    assert rows(docs) == [(4, "b"), (5, "c")] and rows(link) == [(2, 4), (3, 5)]
    back = mutate.attach_document(bare, docs, link, "doc")
    assert [r["doc"] and r["doc"]["n"] for r in back.orderBy("id").collect()] == [None, "b", "c"]
    assert rows(mutate.set_properties(nodes, F.col("id") == 1, {"p": F.lit("s")}).select("id", "p")) == [(1, "s"), (2, "x"), (3, "y")]
    assert rows(mutate.remove_properties(nodes, F.col("id") == 2, ["p"]).where("p is not null").select("id")) == [(3,)]
    assert rows(mutate.encrypted_equal(nodes, "name", "b", b"k").select("id")) == [(2,)]
    assert rows(mutate.upsert(nodes, F.col("id") == 9, {}, spark.createDataFrame([("n",)], "name string"), ["name"]).select("id"))[-1] == (4,)
    _, made = mutate.foreach(nodes, F.array(F.lit(1), F.lit(2)), "x", lambda r: r.select("id", "x"))
    assert made.count() == 6


def test_catalog_rules(spark):
    g = GraphCatalog(spark).node("N", spark.createDataFrame([(1, "a", None), (2, "a", 5)], "id long, k string, v int"), required=("v",), unique=("k",), defaults={"v": 7})
    assert rows(g.nodes["N"].violations()) == [("k", "unique", 2), ("v", "not null", 1)]
    assert rows(g.scan("N").select("id", "v")) == [(1, 7), (2, 5)]


def test_dump_and_restore(spark, tmp_path):
    g = GraphCatalog(spark).node("N", spark.createDataFrame([(1, "it's"), (2, None)], "id long, name string"))
    g.edge("E", spark.createDataFrame([(1, 2, 5)], "src long, dst long, w long"), source="N", target="N")
    dumps.export_json(g, str(tmp_path))
    h = dumps.restore_json(spark, str(tmp_path), {"N": T.StructType().add("name", "string")}, {"E": T.StructType().add("w", "long")})
    assert rows(h.nodes["N"].df.fillna("")) == rows(g.nodes["N"].df.fillna("")) and rows(h.edges["E"].df) == [(1, 2, 5)] and h.edges["E"].source == "N"
    assert [r["statement"] for r in dumps.script(g).orderBy("ord", "statement").collect()] == ["CREATE (:N {id: 1, name: 'it\\'s'})", "CREATE (:N {id: 2})", "MATCH (a:N {id: 1}), (b:N {id: 2}) CREATE (a)-[:E]->(b)"]
    import struct

    (tmp_path / "v.fvecs").write_bytes(b"".join(struct.pack("<i2f", 2, *v) for v in ((1, 2), (3, 4))))
    assert [list(r["embedding"]) for r in dumps.read_fvecs(spark, str(tmp_path / "v.fvecs"), 2).orderBy("id").collect()] == [[1, 2], [3, 4]]


def test_change_feed(spark, tmp_path):
    at = datetime(2024, 1, 1)
    feed = spark.createDataFrame([(1, at, "create", "node", "N", 1, None, None, "{}"), (2, at, "create", "edge", "E", None, 1, 2, "{}"), (3, at, "create", "edge", "F", None, 1, 2, "{}"), (4, at, "migrate", "node", "N", 1, None, None, "{}")], changes.CHANGE)
    feed.write.parquet(str(tmp_path / "feed"))
    got = []
    q = changes.after_commit(changes.subscribe(spark, str(tmp_path / "feed"), types=["E"]), lambda b, n: got.extend(r["seq"] for r in b.collect()), str(tmp_path / "c"), str(tmp_path / "dead"))
    q.awaitTermination(120)
    assert sorted(got) == [1, 2]

    def fails(batch, number):
        raise ValueError("no")

    changes.after_commit(changes.subscribe(spark, str(tmp_path / "feed")), fails, str(tmp_path / "c2"), str(tmp_path / "dead")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "dead")).select("error").distinct().first()["error"] == "no"
    with pytest.raises(changes.BeforeCommitError):
        changes.before_commit(feed, {"has id": F.col("id").isNotNull()})
    assert changes.before_commit(feed, {"has seq": F.col("seq").isNotNull()}) is feed
    assert len(changes.cascade(spark.range(3), lambda d: d.where("id > 0").selectExpr("id - 1 AS id"))) == 3
    with pytest.raises(changes.BeforeCommitError):
        changes.cascade(spark.range(3), lambda d: d)
    agg = changes.windowed(spark.readStream.schema(changes.CHANGE).parquet(str(tmp_path / "feed")), "1 hour", "2 hours", meta="name", value="seq")
    assert agg.isStreaming and changes.sessions(feed.withColumn("meta", F.lit(1)), "5 minutes", "1 hour").count() == 1
