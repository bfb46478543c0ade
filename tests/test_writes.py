"""Writes, catalogue statements, procedures and time travel in query text, over small graphs."""

import pytest
from heliograph.cypher.parser import CypherError
from heliograph.graph import Graph
from heliograph.operators.mutate import WriteError
from heliograph.plans.catalog import GraphCatalog


@pytest.fixture()
def g(spark):
    c = GraphCatalog(spark)
    c.node("User", spark.createDataFrame([(1, "Alice", 30, ["a"]), (2, "Bob", 25, None), (3, "Cara", None, ["b", "b"])], "id long, name string, age long, tags array<string>"))
    c.node("Movie", spark.createDataFrame([(1, "Matrix"), (2, "Alien")], "id long, title string"))
    c.edge("KNOWS", spark.createDataFrame([(1, 2, 5), (2, 3, 6)], "src long, dst long, since long"), source="User", target="User")
    c.edge("LIKES", spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "src long, dst long"), source="User", target="Movie")
    return Graph(c)


def rows(graph, text, **params):
    return sorted(map(tuple, graph.query(text, **params).collect()), key=str)


def test_create_and_return(g):
    w = g.write("CREATE (a:User {name: 'Dan', age: 1 + 1})-[r:KNOWS {since: 9}]->(b:User {name: 'Eve'}) RETURN a.name AS a, id(b) AS b, r.since AS s")
    assert [tuple(r) for r in w.rows.collect()] == [("Dan", 5, 9)]
    assert rows(w.graph, "MATCH (a:User)-[r:KNOWS]->(b:User) WHERE r.since = 9 RETURN a.name AS a, a.age AS age, b.name AS b") == [("Dan", 2, "Eve")]
    assert rows(g, "MATCH (u:User) RETURN count(*) AS n") == [(3,)]  # the old graph stays
    with pytest.raises(WriteError, match="from User to Movie"):
        g.write("MATCH (u:User {name: 'Bob'}) CREATE (u)-[:LIKES]->(u)")
    # Adjacency is a set.
    again = g.write("MATCH (a:User {name: 'Alice'}) MATCH (b:User {name: 'Bob'}) CREATE (a)-[:KNOWS]->(b)").graph
    assert rows(again, "MATCH (a:User)-[r:KNOWS]->(b:User) RETURN count(*) AS n, sum(r.since) AS s") == [(2, 11)]


def test_set_and_remove(g):
    out = g.write("MATCH (u:User) WHERE u.age IS NOT NULL SET u.age = u.age * 2, u.half = u.age / 2, doc_push(u.nums, 7), u:Grown").graph
    assert rows(out, "MATCH (u:User) RETURN u.name AS n, u.age AS a, u.half AS h, u.nums AS x") == [("Alice", 60, 30, [7]), ("Bob", 50, 25, [7]), ("Cara", None, None, None)]
    assert rows(out, "MATCH (u:Grown) RETURN u.name AS n") == [("Alice",), ("Bob",)]
    assert rows(out.write("MATCH (u:User {name: 'Bob'}) REMOVE u:Grown, u.age").graph, "MATCH (u:Grown) RETURN u.name AS n") == [("Alice",)]
    only = g.write("MATCH (u:User {name: 'Bob'}) SET u = {name: 'Rob'}").graph
    assert rows(only, "MATCH (u:User {name: 'Rob'}) RETURN u.age AS a, u.tags AS t") == [(None, None)]
    edge = g.write("MATCH (a:User)-[r:KNOWS]->(b:User {name: 'Cara'}) SET r.since = r.since + 10").graph
    assert rows(edge, "MATCH (:User)-[r:KNOWS]->(:User) RETURN r.since AS s") == [(16,), (5,)]
    # Of several rows that set one property, the last wins.
    last = g.write("MATCH (u:User {name: 'Bob'}) UNWIND [3, 1, 2] AS x SET u.age = x").graph
    assert rows(last, "MATCH (u:User {name: 'Bob'}) RETURN u.age AS a") == [(2,)]
    params = g.write("MATCH (u:User {name: 'Bob'}) SET u += $more", more={"age": 4, "city": "X"}).graph
    assert rows(params, "MATCH (u:User {name: 'Bob'}) RETURN u.age AS a, u.city AS c") == [(4, "X")]
    nested = g.write("MATCH (u:User) SET u.at = {lat: 1, lon: 2} SET u.at.lat = 5").graph
    assert rows(nested, "MATCH (u:User {name: 'Bob'}) RETURN u.at.lat AS a, u.at.lon AS b") == [(5, 2)]


def test_delete(g):
    with pytest.raises(WriteError, match="still have"):
        g.write("MATCH (u:User {name: 'Bob'}) DELETE u")
    out = g.write("MATCH (u:User {name: 'Bob'}) DETACH DELETE u").graph
    assert rows(out, "MATCH (a:User)-[:KNOWS]->(b:User) RETURN count(*) AS n") == [(0,)]
    # Movie 2 has Bob's id and stays.
    assert rows(out, "MATCH (m:Movie) RETURN count(*) AS n") == [(2,)] and rows(out, "MATCH (:User)-[:LIKES]->(m:Movie) RETURN m.title AS t") == [("Alien",), ("Matrix",)]
    assert rows(g.write("MATCH (:User)-[r:KNOWS]->(:User {name: 'Cara'}) DELETE r").graph, "MATCH (:User)-[r:KNOWS]->(:User) RETURN r.since AS s") == [(5,)]


def test_merge(g):
    out = g.write("UNWIND ['Bob', 'Zed', 'Zed'] AS n MERGE (u:User {name: n}) ON CREATE SET u.age = 0 ON MATCH SET u.age = 99 RETURN id(u) AS id")
    assert sorted(r["id"] for r in out.rows.collect()) == [2, 4, 4]
    assert rows(out.graph, "MATCH (u:User) RETURN u.name AS n, u.age AS a") == [("Alice", 30), ("Bob", 99), ("Cara", None), ("Zed", 0)]
    made = g.write("MERGE (a:User {name: 'Alice'})-[r:RATES {stars: 5}]->(m:Movie {title: 'Heat'}) ON CREATE SET r.new = true").graph
    assert rows(made, "MATCH (a:User)-[r:RATES]->(m:Movie) RETURN a.name AS a, r.stars AS s, r.new AS n, id(m) AS m") == [("Alice", 5, True, 3)]
    again = made.write("MERGE (a:User {name: 'Alice'})-[r:RATES {stars: 5}]->(m:Movie {title: 'Heat'}) ON MATCH SET r.seen = 1").graph
    assert rows(again, "MATCH (a:User)-[r:RATES]->(m:Movie) RETURN r.new AS n, r.seen AS s") == [(True, 1)]
    with pytest.raises(WriteError, match="several nodes"):
        g.write("MERGE (a:User)-[:RATES]->(m:Movie)")
    every = g.write("MERGE ALL (a:User)-[:RATES]->(m:Movie)").graph
    assert rows(every, "MATCH (:User)-[:RATES]->(:Movie) RETURN count(*) AS n") == [(6,)]


def test_upsert_foreach(g):
    text = "UPSERT MATCH (u:User {name: $n}) ON MATCH SET u.hits = 1 ON CREATE CREATE (:User {name: $n, hits: 0})"
    for name, want in (("Bob", 1), ("New", 0)):
        assert rows(g.write(text, n=name).graph, "MATCH (u:User {name: $n}) RETURN u.hits AS h", n=name) == [(want,)]
    out = g.write("MATCH (u:User) FOREACH (t IN u.tags | MERGE (x:Tag {name: t}) CREATE (u)-[:TAGGED]->(x))").graph
    assert rows(out, "MATCH (u:User)-[:TAGGED]->(t:Tag) RETURN u.name AS u, t.name AS t") == [("Alice", "a"), ("Cara", "b")]


def test_refactoring(g):
    out = g.write("MATCH (a:User {name: 'Alice'}) MATCH (b:User {name: 'Bob'}) MERGE NODES (a, b) INTO a ON CONFLICT COALESCE TRANSFER EDGES FROM b TO a ON DUPLICATE KEEP TARGET").graph
    assert rows(out, "MATCH (a:User)-[:KNOWS]->(b:User) RETURN a.name AS a, b.name AS b") == [("Alice", "Alice"), ("Alice", "Cara")]
    without = g.write("MATCH (a:User {name: 'Alice'}) MATCH (b:User {name: 'Bob'}) MERGE NODES (a, b) INTO a").graph
    assert rows(without, "MATCH (a:User)-[:KNOWS]->(b:User) RETURN count(*) AS n") == [(0,)]
    copy = g.write("MATCH (u:User {name: 'Bob'}) CLONE NODE u AS c WITH EDGES SET c.name = 'Bob 2' RETURN c.name AS n, c.age AS a, id(c) AS i")
    assert [tuple(r) for r in copy.rows.collect()] == [("Bob 2", 25, 4)]
    assert rows(copy.graph, "MATCH (u:User {name: 'Bob 2'})-[:LIKES]->(m:Movie) RETURN m.title AS t") == [("Matrix",)]
    moved = g.write("MATCH (a:User {name: 'Bob'}) MATCH (b:User {name: 'Cara'}) REDIRECT EDGES FROM a TO b DIRECTION OUTGOING").graph
    assert rows(moved, "MATCH (a:User)-[:KNOWS]->(b:User) RETURN a.name AS a, b.name AS b") == [("Alice", "Bob"), ("Cara", "Cara")]
    with pytest.raises(WriteError, match="no document"):
        g.write("MATCH (u:User) DETACH DOCUMENT u.age AS (a:Age)-[:OF]->(u)")
    doc = g.write("MATCH (u:User) WHERE u.age IS NOT NULL SET u.home = {city: u.name} DETACH DOCUMENT u.home AS (a:Address)-[:HOME_OF]->(u)").graph
    assert rows(doc, "MATCH (a:Address)-[:HOME_OF]->(u:User) RETURN a.city AS c, u.home AS h") == [("Alice", None), ("Bob", None)]
    back = doc.write("ATTACH (a:Address)-[:HOME_OF]->(u:User) INTO u.home ON REMAINING FAIL").graph
    assert rows(back, "MATCH (u:User) RETURN u.home.city AS c") == [("Alice",), ("Bob",), (None,)]
    assert rows(back, "MATCH (a:Address) RETURN count(*) AS n") == [(0,)]


def test_schema_and_indexes(g):
    out = g.write("CREATE NODE TYPE Log WITH (line: string NOT NULL, n: int)").graph
    with pytest.raises(WriteError, match="needs"):
        out.write("CREATE (:Log {n: 1})")
    strict = out.write("ALTER LABEL Log SET SCHEMA strict").graph
    with pytest.raises(WriteError, match="no properties"):
        strict.write("CREATE (:Log {line: 'x', other: 1})")
    with pytest.raises(WriteError, match="rules"):
        strict.write("CREATE (:Log {line: 'x'})").graph.write("MATCH (l:Log) SET l.line = null")
    kept = strict.write("CREATE (:Log {line: 'x'})").graph.write("MATCH (l:Log) SET l.line = null ON VIOLATION SKIP").graph
    assert rows(kept, "MATCH (l:Log) RETURN l.line AS l") == [("x",)]
    unique = g.write("CREATE UNIQUE INDEX by_name ON :User(name)").graph.write("ALTER LABEL User SET SCHEMA validated").graph
    with pytest.raises(WriteError, match="rules"):
        unique.write("MATCH (u:User {name: 'Bob'}) SET u.name = 'Alice'")
    assert "User.name" in unique.catalog.indexes and "User.name" not in unique.write("DROP INDEX by_name").graph.catalog.indexes
    for text in ("CREATE VECTOR INDEX v ON :User(e) OPTIONS {m: 16}", "CREATE TEXT INDEX t ON :User(name) LANGUAGE \"english\"", "CREATE ENCRYPTED INDEX s ON :User(name)"):
        made = g.write(text).graph
        kind, name = text.split()[1], text.split()[3]
        assert len(made.catalog.indexes) == 1 and not made.write(f"DROP {kind} INDEX {name}").graph.catalog.indexes
    temporal = g.write("CREATE EDGE TYPE WORKS TEMPORAL WITH (role: string)").graph
    with pytest.raises(WriteError, match="valid_from"):
        temporal.write("MATCH (a:User {name: 'Bob'}) CREATE (a)-[:WORKS {role: 'x'}]->(a)")
    with pytest.raises(CypherError, match="temporal"):
        temporal.write("CREATE EDGE TYPE WORKS")


def test_triggers(g):
    on = g.write("CREATE TRIGGER mark ON :User CREATE BEFORE COMMIT EXECUTE MATCH (u:User) WHERE u.seen IS NULL MERGE (:Audit {name: u.name})").graph
    assert [r["name"] for r in on.query("SHOW TRIGGERS").collect()] == ["mark"] and on.query("SHOW SESSIONS").count() == 1 and on.query("SHOW TRANSACTIONS").count() == 0
    assert rows(on.write("CREATE (:User {name: 'Dan', seen: null})").graph, "MATCH (a:Audit) RETURN count(*) AS n") == [(4,)]
    off = on.write("ALTER TRIGGER mark DISABLE").graph
    assert rows(off.write("CREATE (:User {name: 'Dan'})").graph, "MATCH (a:Audit) RETURN count(*) AS n") == [(0,)]
    assert on.write("DROP TRIGGER mark").graph.query("SHOW TRIGGERS").count() == 0
    loop = g.write("CREATE TRIGGER again ON :User UPDATE BEFORE COMMIT EXECUTE MATCH (u:User) SET u.n = 1 MAXDEPTH 2").graph
    with pytest.raises(CypherError, match="cascade"):
        loop.write("MATCH (u:User) SET u.age = 1")
    late = g.write("CREATE TRIGGER late ON [:KNOWS] DELETE AFTER COMMIT EXECUTE MATCH (u:User {name: 'Bob'}) DELETE u ON ERROR RETRY 1").graph
    done = late.write("MATCH (:User)-[r:KNOWS]->(:User {name: 'Cara'}) DELETE r")
    assert [d["trigger"] for d in done.dead_letters] == ["late"] and rows(done.graph, "MATCH (u:User) RETURN count(*) AS n") == [(3,)]


def test_procedures_and_explain(g):
    g.rows("MATCH (u:User {name: 'Bob'}) RETURN u.age AS a")
    g.rows("MATCH (u:User {name: 'Cara'}) RETURN u.age AS a")
    (r,) = g.query("CALL db.advisor.queryStats() YIELD query, count AS n RETURN query, n").collect()
    assert r["n"] == 2 and "?" in r["query"]
    (s,) = g.query("CALL db.advisor.suggestions() YIELD id, kind").where("kind = 'missing index'").collect()
    assert g.query("CALL db.advisor.dismiss($id) YIELD dismissed", id=s["id"]).first()[0] is True
    assert g.query("CALL db.advisor.suggestions() YIELD kind").where("kind = 'missing index'").count() == 0
    assert g.query("CALL db.advisor.slowQueries(5, 1)").count() >= 1
    assert g.query("CALL db.advisor.reset()").first()[0] == "OK"
    with pytest.raises(CypherError, match="no procedure"):
        g.query("CALL db.nothing()")
    lines = [r["plan"] for r in g.query("EXPLAIN SUGGEST MATCH (u:User {name: 'Bob'}) RETURN u.age AS a").collect()]
    assert lines[0].startswith("Cost:") and any("missing index" in x for x in lines) and not any("missing index" in r["plan"] for r in g.query("EXPLAIN MATCH (u:User {name: 'Bob'}) RETURN u.age AS a").collect())


def test_as_of_timestamp(spark):
    c = GraphCatalog(spark)
    df = spark.sql("SELECT * FROM VALUES (1L, 'old', timestamp'2024-01-01', timestamp'2024-02-01'), (1L, 'new', timestamp'2024-02-01', null) t(id, name, created_at, deleted_at)")
    g = Graph(c.node("Doc", df, versioned=True))
    assert rows(g, "MATCH (d:Doc) RETURN d.name AS n") == [("new",)]
    for at, want in (("'2024-01-15'", [("old",)]), ("'2024-03-01'", [("new",)]), ("'2023-01-01'", []), ("1705276800000", [("old",)])):
        assert rows(g, f"MATCH (d:Doc) AS OF TIMESTAMP {at} RETURN d.name AS n") == want


def test_fusion_errors(g):
    for text, message in (
        ("RETURN rrf_score([u.tags], {vector: [1.0]}, {k: 9}) AS s", "not tunable"),
        ("RETURN rrf_score([], {vector: [1.0]}) AS s", "non-empty"),
        ("RETURN rrf_score([u.name], {other: 1}) AS s", "vector and text"),
        ("RETURN rrf_score([u.name], {vector: [1.0]}) AS s", "cannot be scored"),
        ("RETURN rrf_score([u.age + 1], {vector: [1.0]}) AS s", "property accesses"),
        ("WHERE rrf_score([u.name], {text: 'x'}) > 0 RETURN u", "WHERE"),
        ("RETURN rrf_score([u.name], {text: 'x'}) AS a, cc_score([u.name], {text: 'y'}, {text: 1.0}) AS b", "WITH"),
        ("RETURN hybrid_score(u, 'x') AS s", "text_match"),
    ):
        with pytest.raises(CypherError, match=message):
            g.query("MATCH (u:User) " + text)
    assert rows(g, "MATCH (u:User) WITH u, rrf_score([u.name], {text: 'bob'}) AS s ORDER BY s DESC RETURN u.name AS n LIMIT 1") == [("Bob",)]
