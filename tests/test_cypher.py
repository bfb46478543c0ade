"""Query text over small graphs, with the rows that it must give."""

import pytest
from heliograph.cypher.parser import CypherError
from heliograph.graph import Graph
from heliograph.plans import advisor
from heliograph.plans.catalog import GraphCatalog


@pytest.fixture(scope="module")
def g(spark):
    c = GraphCatalog(spark)
    c.node("Person", spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 30), (4, "Dave", 40), (5, "Eve", 35)], "id long, name string, age long"))
    c.node("Movie", spark.createDataFrame([(1, "Matrix")], "id long, title string"))
    c.edge("KNOWS", spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src long, dst long"), source="Person", target="Person")
    c.edge("LIKES", spark.createDataFrame([(1, 5)], "src long, dst long"), source="Person", target="Person")
    c.edge("SAW", spark.createDataFrame([(2, 1, 5)], "src long, dst long, stars long"), source="Person", target="Movie")
    c.edge("RING", spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"), source="Person", target="Person")
    c.edge("WORKED", spark.createDataFrame([(1, 2, 0, 100), (1, 3, 100, None)], "src long, dst long, valid_from long, valid_to long"), temporal=True)
    return Graph(c)


CASES = [
    ("MATCH (n:Person) RETURN count(*) AS c, sum(n.age) AS s, avg(n.age) AS a", [(5, 160, 32.0)]),
    ("MATCH (:Person {name: 'Alice'})-[:KNOWS]->(b) RETURN b.name ORDER BY b.name", [("Bob",), ("Charlie",)]),
    ("MATCH (b)<-[:KNOWS]-(a) WHERE a.name = 'Bob' RETURN b.name", [("Charlie",)]),
    ("MATCH (a:Person)-[r:SAW {stars: 5}]->(m) RETURN a.name, m.title, r.stars", [("Bob", "Matrix", 5)]),
    ("MATCH (a:Person {name: 'Alice'})-[r:KNOWS|LIKES]->(b) RETURN type(r), b.name ORDER BY b.name", [("KNOWS", "Bob"), ("KNOWS", "Charlie"), ("LIKES", "Eve")]),
    ("MATCH (a:Person {name: 'Charlie'})-[:KNOWS]-(b) RETURN b.name ORDER BY b.name", [("Alice",), ("Bob",), ("Dave",)]),
    ("MATCH (a:Person {name: 'Alice'})-[:KNOWS*1..3]->(b) RETURN b.name AS n, count(*) AS c ORDER BY n", [("Bob", 1), ("Charlie", 2), ("Dave", 2)]),
    ("MATCH (a:Person {name: 'Alice'})-[:KNOWS*2..2]->(b) RETURN b.name AS n ORDER BY n", [("Charlie",), ("Dave",)]),
    ("MATCH (a:Person {name: 'Alice'})-[:KNOWS*5..2]->(b) RETURN b.name", []),
    ("MATCH (a:Person {name: 'Alice'})-[:RING*1..10]->(b) RETURN count(*) AS n", [(3,)]),
    ("MATCH (a:Person {name: 'Alice'})-[:KNOWS*0..1]->(b) RETURN b.name AS n ORDER BY n", [("Alice",), ("Bob",), ("Charlie",)]),
    ("MATCH p = (a:Person {name: 'Alice'})-[:KNOWS*2..2]->(b) RETURN length(p) AS l, nodes(p) AS n ORDER BY n", [(2, [1, 2, 3]), (2, [1, 3, 4])]),
    ("MATCH (a:Person {name: 'Alice'}), (b:Person {name: 'Dave'}) MATCH p = shortestPath((a)-[:KNOWS*]->(b)) RETURN nodes(p) AS n", [([1, 3, 4],)]),
    ("MATCH (a:Person {name: 'Eve'}), (b:Person {name: 'Dave'}) MATCH p = shortestPath((a)-[:KNOWS*]->(b)) RETURN a.name, p IS NULL AS none", [("Eve", True)]),
    ("MATCH (a:Person {name: 'Eve'}) MATCH p = shortestPath((a)-[:KNOWS*]->(a)) RETURN length(p) AS l", [(0,)]),
    ("MATCH (a:Person) WHERE NOT (a)-[:KNOWS]->() RETURN a.name ORDER BY a.name", [("Dave",), ("Eve",)]),
    ("MATCH (a:Person) WHERE (a)-[:LIKES]->() OR a.age = 40 RETURN a.name ORDER BY a.name", [("Alice",), ("Dave",)]),
    ("MATCH (a:Person) RETURN a.name AS n, COUNT { (a)-[:KNOWS]->(b) } AS k ORDER BY n", [("Alice", 2), ("Bob", 1), ("Charlie", 1), ("Dave", 0), ("Eve", 0)]),
    ("MATCH (a:Person {name: 'Charlie'}) OPTIONAL MATCH (b:Person) WHERE b.age > a.age RETURN a.name, b.name ORDER BY b.name", [("Charlie", "Dave"), ("Charlie", "Eve")]),
    ("MATCH (a:Person {name: 'Dave'}) OPTIONAL MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name", [("Dave", None)]),
    ("OPTIONAL MATCH (a:Person {name: 'Zed'}) RETURN a.name", [(None,)]),
    ("MATCH (a:Person) CALL { WITH a MATCH (a)-[:KNOWS]->(b) RETURN count(b) AS c } RETURN a.name, c ORDER BY a.name LIMIT 4", [("Alice", 2), ("Bob", 1), ("Charlie", 1), ("Dave", 0)]),
    ("MATCH (a:Person {name: 'Alice'}) RETURN [(a)-[:KNOWS]->(b) WHERE b.age > 26 | b.name] AS l, a{.name, next: a.age + 1} AS m", [(["Charlie"], ("Alice", 31))]),
    ("MATCH (a:Person) WHERE a.age = 30 RETURN a.name AS x UNION ALL MATCH (a:Person) WHERE a.name = 'Alice' RETURN a.name AS x", [("Alice",), ("Charlie",), ("Alice",)]),
    ("MATCH (a:Person) WHERE a.age = 30 RETURN 1 AS x UNION MATCH (a:Person) RETURN 1 AS x", [(1,)]),
    ("MATCH (a:Person) WITH a.age AS age, collect(a.name) AS names WHERE size(names) > 1 RETURN age, size(names) AS n", [(30, 2)]),
    ("MATCH (a:Person) RETURN percentileCont(a.age, 0.5) AS m, percentileDisc(a.age, 0.0) AS d, percentileDisc(a.age, 1.0) AS u", [(30.0, 25.0, 40.0)]),
    ("MATCH (a:Person) RETURN count(DISTINCT a.age) * 10 AS n", [(40,)]),
    ("MATCH (a:Person) RETURN a.name ORDER BY a.age DESC, a.name SKIP 1 LIMIT 2", [("Eve",), ("Alice",)]),
    ("MATCH (a:Person) RETURN DISTINCT a.age AS age ORDER BY age", [(25,), (30,), (35,), (40,)]),
    ("MATCH (a:Person)-[r:WORKED]->(b:Person) WHERE temporal_active_at(r, 100) RETURN b.name", [("Charlie",)]),
    ("MATCH (a:Person)-[r:WORKED]->(b:Person) WHERE temporal_active_at(r, 99) RETURN b.name", [("Bob",)]),
    ("MATCH (a:Person)-[r:WORKED]->(b:Person) WHERE NOT temporal_active_at(r, NULL) RETURN count(*) AS n", [(2,)]),
    ("MATCH (a:Person)-[r:KNOWS]->(b) WHERE temporal_active_at(r, 1) RETURN count(*) AS n", [(0,)]),
    ("MATCH (a:Person)-[r:WORKED]->(b:Person) WHERE temporal_overlaps(r, 50, 101) RETURN count(*) AS n", [(2,)]),
    ("MATCH (a:Person {name: 'Alice'})-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN c.name AS n ORDER BY n", [("Charlie",), ("Dave",)]),
    ("UNWIND [1, 2, 3] AS x UNWIND [x, x * 10] AS y RETURN sum(y) AS s", [(66,)]),
    ("UNWIND 5 AS x RETURN x", [(5,)]),
    ("MATCH (a:Person {name: $who}) RETURN a.age AS age, $missing IS NULL AS m", [(30, True)]),
    ("MATCH (a:Person {name: 'Alice'}) RETURN id(a) AS i, elementId(a) AS e, labels(a) AS l, keys(a) AS k, a AS bare", [(1, "0000000000001", ["Person"], ["age", "name"], 1)]),
]


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, tuple) else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("text,rows", CASES, ids=[c[0][:60] for c in CASES])
def test_rows(g, text, rows):
    assert [plain(tuple(r)) for r in g.query(text, who="Alice").collect()] == rows


VALUES = [
    ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("1 / 0", None), ("1.0 / 0", None), ("7 % 3", 1), ("7 % 0", None), ("7.5 % 2", None),
    ("9223372036854775807 + 1", 9223372036854775807), ("9223372036854775807 * -2", -(1 << 63)), ("-9223372036854775807 - 5", -(1 << 63)),
    ("'a' + 'b'", "ab"), ("'a' + 1", None), ("[1] + [2]", [1, 2]), ("[1] + 2", [1, 2]), ("0 + [1]", [0, 1]),
    ("1 <= 1.0", True), ("1 < 'a'", False), ("true OR NULL", None), ("false AND NULL", None), ("NOT true", False), ("true XOR false", True),
    ("NULL = NULL", None), ("2 IN [1, NULL]", False), ("NULL IN [1, NULL]", True), ("1 IN NULL", None),
    ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 1), ("nullIf(1, 1)", None), ("coalesce(NULL, 2)", 2),
    ("all(x IN [1, NULL] WHERE x > 0)", False), ("any(x IN [NULL, 1] WHERE x > 0)", True), ("none(x IN [NULL] WHERE x > 0)", True), ("single(x IN [1, 2] WHERE x > 1)", True),
    ("reduce(s = 0, x IN [1, 2, 3] | s + x)", 6), ("[x IN range(1, 5) WHERE x % 2 = 1 | x * x]", [1, 9, 25]),
    ("[1, 2, 3][-1]", 3), ("[1, 2, 3][9]", None), ("[1, 2, 3, 4][1..3]", [2, 3]), ("[1, 2, 3][-2..]", [2, 3]), ("[1, 2][..9]", [1, 2]),
    ("range(5, 1)", []), ("range(5, 1, -2)", [5, 3, 1]), ("range(1, 2, 0)", None), ("head([])", None), ("last([1, 2])", 2), ("tail([1, 2, 3])", [2, 3]), ("isEmpty('')", True),
    ("size('é')", 2), ("charLength('é')", 1), ("toString(2.0)", "2"), ("toString(true)", "true"), ("toInteger('3.7')", 3), ("toInteger('x')", None), ("toInteger(true)", 1), ("toFloat(true)", None), ("toBoolean('true')", True), ("toBoolean(0)", False),
    ("left('hello', 2)", "he"), ("left('hello', -1)", None), ("substring('hello', 1, 3)", "ell"), ("substring('hello', 9)", ""), ("split('a,b;c', [',', ';'])", ["a", "b", "c"]), ("split('ab', '')", ["ab"]), ("trim('  a ')", "a"), ("reverse([1, 2])", [2, 1]),
    ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("ceil(1.2)", 2.0), ("sign(-3.5)", -1), ("abs(-4)", 4), ("sqrt(16)", 4.0),
    ("'abc' =~ 'a.c'", True), ("'abc' =~ 'b'", False), ("'abc' STARTS WITH 'ab'", True), ("'abc' CONTAINS 'x'", False), ("1 IS :: INTEGER", True), ("'a' IS NOT :: STRING", False), ("valueType([1])", "LIST"),
    ("{a: {b: 5}}.a.b", 5), ("unknownFunction(1)", None), ("keys({b: 1, a: 2})", ["a", "b"]),
    ("vector_distance([0, 3], [4, 0])", 5.0), ("vector_similarity([0, 0], [1, 1])", 0.0), ("vector_dot([1, 2], [3, 4])", 11.0), ("vector_manhattan([1, 2], [3, 5])", 5.0), ("vector_dot([1], [1, 2])", None),
    ("maxsim_score([[1, 0], [0, 1], [0.5, 0.5]], [[1, 0], [0, 1]])", 2.0),
    ("normalize('e\u0301')", "\u00e9"), ("normalize('\u00e9', 'nfd')", "e\u0301"), ("normalize('\ufb01', 'NFKC')", "fi"), ("normalize('\ufb01', 'NFKD')", "fi"), ("normalize('a', 'x')", None), ("normalize(5)", None), ("normalize('e\u0301', 5)", "\u00e9"),
]


def test_values(g):
    row = g.query("RETURN " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(VALUES))).first()
    got = {e: row[i] for i, (e, _) in enumerate(VALUES)}
    assert got == dict(VALUES)


def test_strict_numbers(g):
    assert g.query("RETURN 1 = 1.0 AS a, 1 <> 1.0 AS b", strict_numbers=True).first() == (False, True)
    assert g.query("RETURN 1 = 1.0 AS a").first() == (True,)


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "RETURN", "MATCH (a:Person) RETURN b", "MATCH (a:Person) RETURN a.name AS x UNION MATCH (a:Person) RETURN a.name AS y", "RETURN 1 ~ 2", "RETURN text_score() AS s"])
def test_errors(g, text):
    with pytest.raises(CypherError):
        g.query(text)


def test_advisor(g):
    found = lambda q: {s["detector"] for s in advisor.suggestions(g.catalog, q)}
    assert found("MATCH (a:Person {name: 'x'}) RETURN a") == {"missing index"}
    assert found("MATCH (a:Person)-[:KNOWS*]->(b) RETURN b") == {"unbounded traversal"}
    assert found("MATCH (a:Person), (b:Movie) RETURN count(*)") == {"cartesian product"}
    assert found("MATCH (a:Person) RETURN a ORDER BY vector_distance(a.v, [1.0]) LIMIT 3") == {"exact nearest neighbours", "vector without prefilter"}
    assert advisor.fingerprint("MATCH (a)  WHERE a.x = 1 RETURN a") == advisor.fingerprint("MATCH (a) WHERE a.x = 22 RETURN a")
    assert "Scan" in g.explain("MATCH (a:Person) RETURN a.name")
    log = [{"query": "q", "fingerprint": 1, "seconds": s} for s in (1.0, 2.0)] * 5
    assert advisor.repeated(log)[0]["times"] == 10 and advisor.stats(log)[0]["calls"] == 10
