"""Registered queries over the star-schema tables: graph text, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector
from .graph import Graph
from .operators import decay, fusion, mutate, spatial, text, timeseries
from .plans import advisor
from .sources.tables import read, star_graph

#: name -> (query text, SQL, parameters)
TEXTS: dict[str, tuple[str, str | None, dict]] = {}


def graph_text(name: str, query: str, sql: str | None, **params) -> None:
    TEXTS[name] = (query, sql, params)


graph_text(
    "top_nations",
    "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice)) AS value ORDER BY value DESC LIMIT 10",
    "SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice)) AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY value DESC LIMIT 10",
)
graph_text("node_scan", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_name AS name, c.c_acctbal AS balance", "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'")
graph_text("index_lookup", "MATCH (c:Customer) WHERE id(c) = 7 OR id(c) = $k RETURN id(c) AS id, c.c_name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (7, 42)", k=42)
graph_text("filter_null_logic", "MATCH (o:Order) WHERE NOT (o.o_totalprice > 100000 OR nullIf(o.o_orderstatus, 'F') = 'O') RETURN o.o_orderstatus AS status, count(*) AS n", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL AND NOT (o_totalprice > 100000 OR o_orderstatus = 'O') GROUP BY 1")
graph_text("traverse_incoming", "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, s.s_name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000")
graph_text("traverse_two_types", "MATCH (x)-[r:IN_NATION|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, type(r) AS kind, count(*) AS n", "SELECT n_name AS nation, kind, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k, 'IN_NATION' AS kind FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) ON k = n_nationkey GROUP BY ALL")
graph_text("edge_properties", "MATCH (o:Order)-[c:CONTAINS]->(p:Part) WHERE c.quantity >= 80 RETURN id(o) AS o, id(p) AS p, c.quantity AS quantity, c.lines AS lines", "SELECT l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) >= 80")
graph_text("bound_continuation", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, count(DISTINCT c) AS customers", "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 GROUP BY 1")
graph_text("optional_match", "MATCH (c:Customer) WHERE c.c_acctbal < 0 OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 RETURN c.c_name AS name, o.o_totalprice AS price", "SELECT c_name AS name, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 WHERE c_acctbal < 0")
graph_text("cross_match_join", "MATCH (s:Supplier), (c:Customer) WHERE s.s_nationkey = c.c_nationkey AND c.c_acctbal > 9500 AND s.s_acctbal > 9000 RETURN s.s_name AS s, c.c_name AS c", "SELECT s_name AS s, c_name AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9500 AND s_acctbal > 9000")
graph_text("anti_pattern", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
graph_text("semi_pattern", "MATCH (p:Part) WHERE EXISTS { (s:Supplier)-[:SUPPLIES]->(p) WHERE s.s_acctbal > 9000 } RETURN p.p_name AS name", "SELECT p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 9000)")
graph_text("pattern_in_or", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderpriority: '1-URGENT'}) OR c.c_acctbal > 9000 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
graph_text("count_subquery", "MATCH (n:Nation) RETURN n.n_name AS nation, COUNT { (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 0 } AS suppliers", "SELECT n_name AS nation, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS suppliers FROM nation")
graph_text("pattern_comprehension", "MATCH (n:Nation) WITH n, [(n)<-[:BASED_IN]-(s:Supplier) | s.s_acctbal] AS b RETURN n.n_name AS nation, size(b) AS k, reduce(m = 0.0, x IN b | CASE WHEN x > m THEN x ELSE m END) AS best", "SELECT n_name AS nation, count(s_suppkey) AS k, coalesce(max(greatest(s_acctbal, 0)), 0.0)::DOUBLE AS best FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
graph_text("call_subquery", "MATCH (c:Customer) WHERE c.c_acctbal > 9900 CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN count(o) AS orders, max(o.o_totalprice) AS top } RETURN c.c_name AS name, orders, top", "SELECT c_name AS name, count(o_orderkey) AS orders, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9900 GROUP BY 1")
graph_text("unwind", "MATCH (r:Region) UNWIND range(1, size(r.r_name) % 4 + 1) AS i WITH r, i WHERE i % 2 = 1 RETURN r.r_name AS region, i", "SELECT r_name AS region, i FROM region, unnest(range(1, strlen(r_name) % 4 + 2)) AS t(i) WHERE i % 2 = 1")
graph_text("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
graph_text("union_all", "MATCH (s:Supplier) WHERE s.s_acctbal > 9000 RETURN s.s_name AS x UNION ALL MATCH (s:Supplier) WHERE s.s_acctbal > 8000 RETURN s.s_name AS x", "SELECT s_name AS x FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 8000")
graph_text("distinct_rows", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS brand, p.p_size / 10 AS decade", "SELECT DISTINCT p_brand AS brand, (p_size // 10)::BIGINT AS decade FROM part")
graph_text("skip_limit", "MATCH (p:Part) RETURN id(p) AS id, p.p_retailprice AS price ORDER BY price DESC, id SKIP 5 LIMIT 20", "SELECT p_partkey AS id, p_retailprice AS price FROM part ORDER BY price DESC, id LIMIT 20 OFFSET 5")
graph_text("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_mktsegment AS segment, o.o_orderstatus AS status, count(*) AS n WHERE n > 100 RETURN segment, status, n", "SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 100")
graph_text("aggregates", "MATCH (p:Part) RETURN p.p_brand AS brand, count(*) AS n, count(DISTINCT p.p_type) AS types, sum(p.p_size) AS size, round(avg(p.p_retailprice) * 100) AS mean, min(p.p_name) AS first, max(p.p_size) AS largest, round(stDev(p.p_size) * 10000) AS sd, round(stDevP(p.p_size) * 10000) AS sdp", "SELECT p_brand AS brand, count(*) AS n, count(DISTINCT p_type) AS types, sum(p_size)::BIGINT AS size, round(avg(p_retailprice) * 100) AS mean, min(p_name) AS first, max(p_size) AS largest, round(stddev_samp(p_size) * 10000) AS sd, round(stddev_pop(p_size) * 10000) AS sdp FROM part GROUP BY 1")
graph_text("percentiles", "MATCH (o:Order) RETURN o.o_orderstatus AS status, round(percentileCont(o.o_totalprice, 0.9) * 100) AS p90, percentileDisc(o.o_totalprice, 0.5) AS median", "SELECT o_orderstatus AS status, round(quantile_cont(o_totalprice, 0.9) * 100) AS p90, quantile_disc(o_totalprice, 0.5) AS median FROM orders GROUP BY 1")
graph_text("collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS region, collect(n.n_name) AS names RETURN region, size(names) AS n, any(x IN names WHERE x STARTS WITH 'A') AS a, none(x IN names WHERE x CONTAINS 'Z') AS z", "SELECT r_name AS region, count(*) AS n, bool_or(n_name LIKE 'A%') AS a, NOT bool_or(n_name LIKE '%Z%') AS z FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
graph_text("empty_aggregate", "MATCH (c:Customer {c_name: 'nobody'}) RETURN count(*) AS n, sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a", "SELECT count(*) AS n, sum(c_acctbal) AS s, avg(c_acctbal) AS a FROM customer WHERE c_name = 'nobody'")
graph_text("var_length", "MATCH (p:Part {p_size: 7})-[:PARENT*2..4]->(q:Part) RETURN id(p) AS p, id(q) AS q", "SELECT p_partkey AS p, q.p_partkey AS q FROM part p JOIN (VALUES (4), (8), (16)) d(k) ON p.p_partkey // k >= 1 JOIN (SELECT p_partkey FROM part) q ON q.p_partkey = p.p_partkey // k WHERE p_size = 7".replace("SELECT p_partkey AS p", "SELECT p.p_partkey AS p"))
graph_text("var_length_distinct", "MATCH (p:Part {p_size: 7})-[:PARENT*1..3]->(q:Part) RETURN count(DISTINCT q) AS n", "SELECT count(DISTINCT p_partkey // k) AS n FROM part, (VALUES (2), (4), (8)) d(k) WHERE p_size = 7 AND p_partkey // k >= 1")
graph_text("named_path", "MATCH p = (a:Part {p_size: 9})-[:PARENT*1..2]->(b:Part) RETURN id(a) AS a, id(b) AS b, length(p) AS hops, nodes(p)[1] AS via", "SELECT p_partkey AS a, p_partkey // k AS b, h::BIGINT AS hops, p_partkey // 2 AS via FROM part, (VALUES (2, 1), (4, 2)) d(k, h) WHERE p_size = 9 AND p_partkey // k >= 1")
# Every part of the size with each of its near ancestors: as many pairs as parts, at any size.
graph_text("shortest_path", "MATCH (a:Part {p_size: 9})-[:PARENT*1..3]->(b:Part) MATCH p = shortestPath((a)-[:PARENT*..3]-(b)) RETURN id(a) AS a, id(b) AS b, length(p) AS hops", "SELECT p_partkey AS a, p_partkey // k AS b, h::BIGINT AS hops FROM part, (VALUES (2, 1), (4, 2), (8, 3)) d(k, h) WHERE p_size = 9 AND p_partkey // k >= 1")
graph_text(
    "shortest_path_labels",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (r:Region {r_name: 'ASIA'}) MATCH p = shortestPath((c)-[:IN_NATION|IN_REGION*..4]->(r)) RETURN id(c) AS c, length(p) AS hops",
    "SELECT c_custkey AS c, CASE WHEN r_name = 'ASIA' THEN 2 END::BIGINT AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE EXISTS (FROM region WHERE r_name = 'ASIA')",
)
graph_text("var_length_labels", "MATCH (c:Customer)-[:IN_NATION|IN_REGION*2..2]->(r:Region) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
graph_text("var_length_any", "MATCH (s:Supplier)-[e:BASED_IN|IN_REGION*1..2]->(x) RETURN labels(x)[0] AS label, size(e) AS hops, count(DISTINCT x) AS ends, count(*) AS n", "SELECT 'Nation' AS label, 1 AS hops, count(DISTINCT s_nationkey) AS ends, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'Region', 2, count(DISTINCT n_regionkey), count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
graph_text("exists_any_label", "MATCH (x) WHERE EXISTS { (x)-[:BASED_IN]->(:Nation) } OR EXISTS { (x)-[:IN_REGION]->(:Region) } RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Supplier' AS label, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'Nation', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey")
graph_text("exists_filter_any_label", "MATCH (x) WHERE EXISTS { (x)-[:BASED_IN]->(:Nation) } RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey")
graph_text("temporal_active", "MATCH (u:User)-[r:DID]->(t:EventType) WHERE temporal_active_at(r, $t) RETURN id(u) AS user, t.name AS doing", "WITH e AS (SELECT *, epoch_us(ts) // 1000 AS f, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS u FROM events) SELECT user_id AS user, event_type AS doing FROM e WHERE f <= 1705320000000 AND (u IS NULL OR u > 1705320000000)", t=1705320000000)
graph_text("temporal_overlaps", "MATCH (u:User)-[r:DID]->(t:EventType) WHERE temporal_overlaps(r, $a, $b) AND r.value > 50 RETURN id(u) AS user, t.name AS doing, r.valid_from AS since", "WITH e AS (SELECT *, epoch_us(ts) // 1000 AS f, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS u FROM events) SELECT user_id AS user, event_type AS doing, f AS since FROM e WHERE f < 1705406400000 AND (u IS NULL OR u > 1705320000000) AND value > 50", a=1705320000000, b=1705406400000)
graph_text("normal_forms", "MATCH (d:Document) RETURN id(d) AS id, normalize(d.text) AS nfc, normalize(d.lang, 'none such') AS unknown, size(normalize(d.text)) AS bytes", "SELECT doc_id AS id, nfc_normalize(text) AS nfc, CAST(NULL AS VARCHAR) AS unknown, strlen(nfc_normalize(text)) AS bytes FROM documents")
graph_text("string_functions", "MATCH (c:Customer) RETURN id(c) AS id, toLower(c.c_name) AS lo, toUpper(c.c_mktsegment) AS up, left(c.c_name, 3) AS l, right(c.c_name, 4) AS r, substring(c.c_name, 2, 5) AS s, replace(c.c_name, '#', '-') AS x, reverse(c.c_mktsegment) AS rev, size(c.c_name) AS n, split(c.c_name, '#')[0] AS head, trim('  a ') AS t", "SELECT c_custkey AS id, lower(c_name) AS lo, upper(c_mktsegment) AS up, left(c_name, 3) AS l, right(c_name, 4) AS r, substr(c_name, 3, 5) AS s, replace(c_name, '#', '-') AS x, reverse(c_mktsegment) AS rev, strlen(c_name) AS n, string_split(c_name, '#')[1] AS head, 'a' AS t FROM customer")
graph_text("math_functions", "MATCH (p:Part) RETURN id(p) AS id, abs(p.p_size - 25) AS a, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, sign(p.p_size - 25) AS s, sqrt(p.p_size * p.p_size) AS q, round(log10(p.p_size) * 1000000) AS l, round(sin(p.p_size) * 1000000) AS sn, round(haversin(radians(p.p_size)) * 1000000) AS h, p.p_size % 7 AS m, p.p_size / 7 AS d, p.p_size / 0 AS z", "SELECT p_partkey AS id, abs(p_size - 25)::BIGINT AS a, ceil(p_retailprice)::DOUBLE AS c, floor(p_retailprice)::DOUBLE AS f, sign(p_size - 25)::BIGINT AS s, sqrt(p_size * p_size) AS q, round(log10(p_size) * 1000000) AS l, round(sin(p_size) * 1000000) AS sn, round((1 - cos(radians(p_size))) / 2 * 1000000) AS h, (p_size % 7)::BIGINT AS m, (p_size // 7)::BIGINT AS d, NULL::BIGINT AS z FROM part")
graph_text("conversions", "MATCH (o:Order) RETURN id(o) AS id, toInteger('3.7') AS i, toFloat('2.5') AS f, toBoolean('TRUE') AS b, toInteger('x') AS bad, toString(id(o)) AS s, toInteger(true) AS t, coalesce(null, o.o_orderstatus) AS c, valueType(o.o_totalprice) AS v", "SELECT o_orderkey AS id, 3::BIGINT AS i, 2.5::DOUBLE AS f, TRUE AS b, NULL::BIGINT AS bad, o_orderkey::VARCHAR AS s, 1::BIGINT AS t, o_orderstatus AS c, 'FLOAT' AS v FROM orders")
graph_text("list_functions", "MATCH (r:Region) WITH r, [x IN range(1, 10) WHERE x % (id(r) + 2) = 0 | x * x] AS l RETURN r.r_name AS region, size(l) AS n, head(l) AS h, last(l) AS t, size(tail(l)) AS k, l[-1] AS e, l[0..2] = l[..2] AS same, 25 IN l AS has, isEmpty(l) AS none", "SELECT r_name AS region, len(l) AS n, l[1] AS h, l[-1] AS t, greatest(len(l) - 1, 0) AS k, l[-1] AS e, TRUE AS same, list_contains(l, 25) AS has, len(l) = 0 AS none FROM (SELECT r_name, list_transform(list_filter(range(1, 11), lambda x: x % (r_regionkey + 2) = 0), lambda x: x * x) AS l FROM region)")
graph_text("case_expressions", "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'else' END AS state, CASE WHEN o.o_totalprice > 200000 THEN 1 WHEN o.o_totalprice > 100000 THEN 2 ELSE 3 END AS class, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'else' END AS state, CASE WHEN o_totalprice > 200000 THEN 1 WHEN o_totalprice > 100000 THEN 2 ELSE 3 END::BIGINT AS class, count(*) AS n FROM orders GROUP BY 1, 2")
graph_text("regex_match", "MATCH (p:Part) WHERE p.p_brand =~ 'Brand#[12][0-9]*' RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE regexp_full_match(p_brand, 'Brand#[12][0-9]*') GROUP BY 1")
graph_text("entity_functions", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN id(n) AS id, elementId(g) AS element, type(r) AS t, labels(n)[0] AS label, startNode(r) AS a, endNode(r) AS b, size(keys(n)) AS k", "SELECT n_nationkey::BIGINT AS id, lpad(substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', n_regionkey + 1, 1), 13, '0') AS element, 'IN_REGION' AS t, 'Nation' AS label, n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b, 2::BIGINT AS k FROM nation")
graph_text("map_projection", "MATCH (n:Nation) WITH n{.n_name, up: toUpper(n.n_name)} AS m RETURN m.n_name AS name, m.up AS up", "SELECT n_name AS name, upper(n_name) AS up FROM nation")
graph_text("document_path", "MATCH (s:Supplier) WITH s, {a: {b: s.s_acctbal}} AS d RETURN s.s_name AS name, d.a.b AS balance", "SELECT s_name AS name, s_acctbal AS balance FROM supplier")
_Q = [0.1] * 64
graph_text("vector_filter", "MATCH (v:Vec) WHERE vector_distance(v.embedding, $q) < 1.1 RETURN id(v) AS id, round(vector_distance(v.embedding, $q) * 100000) AS d", f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]) * 100000) AS d FROM embeddings WHERE list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]) < 1.1", q=_Q)
graph_text("vector_top_k", "MATCH (v:Vec) WITH id(v) AS id, vector_distance(v.embedding, $q) AS d ORDER BY d, id LIMIT 25 RETURN id, round(d * 100000) AS d", f"SELECT id, round(d * 100000) AS d FROM (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS d FROM embeddings ORDER BY d, id LIMIT 25)", q=_Q)
graph_text("vector_measures", "MATCH (v:Vec) RETURN id(v) AS id, round(vector_dot(v.embedding, $q) * 100000) AS dot, round(vector_similarity(v.embedding, $q) * 100000) AS cosine, round(vector_manhattan(v.embedding, $q) * 100000) AS l1, vector_dot(v.embedding, [1.0]) AS none", f"SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) * 100000) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) * 100000) AS cosine, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE - 0.1))) * 100000) AS l1, NULL::DOUBLE AS none FROM embeddings", q=_Q)
graph_text("maxsim_top_k", "MATCH (v:Vec) WITH id(v) AS id, maxsim_score([v.embedding[0..32], v.embedding[32..64]], $q) AS s ORDER BY s DESC, id LIMIT 20 RETURN id, round(s * 100000) AS s", f"WITH h AS (SELECT vec_id AS id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b, {_Q[:32]}::DOUBLE[] AS p, {[-x for x in _Q[:32]]}::DOUBLE[] AS q FROM embeddings), s AS (SELECT id, greatest(list_inner_product(a, p), list_inner_product(b, p)) + greatest(list_inner_product(a, q), list_inner_product(b, q)) AS s FROM h ORDER BY s DESC, id LIMIT 20) SELECT id, round(s * 100000) AS s FROM s", q=[_Q[:32], [-x for x in _Q[:32]]])
graph_text("text_match", "MATCH (d:Document) WHERE text_match(d.text, $q) RETURN id(d) AS id, round(text_score() * 100000) AS score ORDER BY score DESC, id LIMIT 50", None, q="license public")
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _bm25(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT id, t, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS dl FROM d, unnest([{listed}]) AS q(t)),
hit AS (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM tf WHERE tf > 0)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 100000) AS score FROM hit, stats GROUP BY id"""


TEXTS["text_match"] = (TEXTS["text_match"][0], _bm25(["license", "public"]) + " ORDER BY score DESC, id LIMIT 50", TEXTS["text_match"][2])


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query, _, params = TEXTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Graph(star_graph(spark, sf_dir)).query(query, **params)

    run.__name__ = name
    run.__doc__ = query
    return run


#: name -> (statement that writes, query over the graph after it, SQL)
WRITES: dict[str, tuple[str, str, str]] = {
    "text_create": (
        "MATCH (n:Nation) WITH n ORDER BY n.n_name CREATE (:Supplier {s_name: n.n_name})",
        "MATCH (s:Supplier) RETURN id(s) AS id, s.s_name AS name",
        "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation",
    ),
    "text_create_edges": (
        "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) CREATE (s)-[:HOME {weight: 2}]->(n), (c:Card {of: s.s_name})-[:OF]->(s)",
        "MATCH (c:Card)-[:OF]->(s:Supplier)-[h:HOME]->(n:Nation) RETURN c.of AS card, id(n) AS nation, h.weight AS weight",
        "SELECT s_name AS card, s_nationkey::BIGINT AS nation, 2::BIGINT AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "text_set": (
        "MATCH (s:Supplier) WHERE s.s_acctbal < 0 SET s.s_acctbal = 0.0, s += {mark: 'low', was: s.s_name}",
        "MATCH (s:Supplier) RETURN id(s) AS id, s.s_acctbal AS balance, s.mark AS mark, s.was AS was",
        "SELECT s_suppkey AS id, greatest(s_acctbal, 0) AS balance, CASE WHEN s_acctbal < 0 THEN 'low' END AS mark, CASE WHEN s_acctbal < 0 THEN s_name END AS was FROM supplier",
    ),
    "text_set_edges": (
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.lines > 1 SET r.quantity = 0.0",
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN id(o) AS o, id(p) AS p, r.quantity AS quantity",
        "SELECT l_orderkey AS o, l_partkey AS p, CASE WHEN count(*) > 1 THEN 0.0 ELSE sum(l_quantity) END AS quantity FROM lineitem GROUP BY 1, 2",
    ),
    "text_remove": (
        "MATCH (p:Part {p_size: 7}) REMOVE p.p_brand",
        "MATCH (p:Part) RETURN id(p) AS id, p.p_brand AS brand",
        "SELECT p_partkey AS id, CASE WHEN p_size <> 7 THEN p_brand END AS brand FROM part",
    ),
    "text_detach_delete": (
        "MATCH (s:Supplier) WHERE s.s_acctbal < 0 DETACH DELETE s",
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN id(s) AS s, id(p) AS p",
        "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)",
    ),
    "text_delete_edges": (
        "MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) WHERE c.c_acctbal < 0 DELETE r",
        "MATCH (c:Customer) WHERE NOT (c)-[:IN_NATION]->() RETURN id(c) AS id",
        "SELECT c_custkey AS id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 OR n_nationkey IS NULL",
    ),
    "text_merge": (
        "MATCH (n:Nation) WITH n.n_name AS name UNWIND [name, 'Supplier#000000003'] AS x WITH DISTINCT x ORDER BY x MERGE (s:Supplier {s_name: x}) ON CREATE SET s.state = 'new' ON MATCH SET s.state = 'there'",
        "MATCH (s:Supplier) RETURN id(s) AS id, s.s_name AS name, s.state AS state",
        "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_name = 'Supplier#000000003' OR s_name IN (SELECT n_name FROM nation) THEN 'there' END AS state FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY x), x, 'new' FROM (SELECT n_name AS x FROM nation UNION SELECT 'Supplier#000000003') WHERE x NOT IN (SELECT s_name FROM supplier)",
    ),
    "text_merge_edges": (
        "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation)-[:IN_REGION]->(r:Region) MERGE (s)-[x:IN_AREA]->(r) ON CREATE SET x.via = n.n_name",
        "MATCH (s:Supplier)-[x:IN_AREA]->(r:Region) RETURN id(s) AS s, r.r_name AS region, x.via AS via",
        "SELECT s_suppkey AS s, r_name AS region, n_name AS via FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "text_merge_all": (
        "MERGE ALL (a:Region)-[t:TRADES]->(b:Region) ON CREATE SET t.level = 1",
        "MATCH (a:Region)-[t:TRADES]->(b:Region) RETURN a.r_name AS a, b.r_name AS b, t.level AS level",
        "SELECT a.r_name AS a, b.r_name AS b, 1::BIGINT AS level FROM region a, region b",
    ),
    "text_upsert": (
        "MATCH (n:Nation) UPSERT MATCH (s:Supplier {s_nationkey: id(n)}) ON MATCH SET s.nation = n.n_name ON CREATE CREATE (:Supplier {s_name: 'of ' + n.n_name, nation: n.n_name})",
        "MATCH (s:Supplier) RETURN s.s_name AS name, s.nation AS nation",
        "SELECT s_name AS name, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'of ' || n_name, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    ),
    "text_foreach": (
        "MATCH (r:Region) FOREACH (i IN range(1, 3) | CREATE (:Tag {region: r.r_name, i: i * 10}))",
        "MATCH (t:Tag) RETURN t.region AS region, t.i AS i",
        "SELECT r_name AS region, i::BIGINT AS i FROM region, (VALUES (10), (20), (30)) t(i)",
    ),
    "text_merge_nodes": (
        "MATCH (a:Supplier) MATCH (b:Supplier) WHERE id(b) = id(a) + 1 AND id(a) % 2 = 1 MERGE NODES (a, b) INTO a ON CONFLICT KEEP LAST TRANSFER EDGES FROM b TO a ON DUPLICATE MERGE PROPERTIES",
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.s_name AS name, id(p) AS part",
        "SELECT DISTINCT s.s_name AS name, l_partkey AS part FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier s ON s.s_suppkey = least(CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey + 1 ELSE l_suppkey END, (SELECT max(s_suppkey) FROM supplier))",
    ),
    "text_clone": (
        "MATCH (s:Supplier) WHERE s.s_acctbal < 0 WITH s ORDER BY id(s) CLONE NODE s AS c WITH EDGES SET c.s_acctbal = 0.0",
        "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) RETURN id(s) AS id, s.s_name AS name, s.s_acctbal AS balance, id(n) AS nation",
        "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_nationkey::BIGINT AS nation FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_suppkey), s_name, 0.0, s_nationkey FROM supplier WHERE s_acctbal < 0",
    ),
    "text_redirect": (
        "MATCH (a:Supplier {s_name: 'Supplier#000000002'}) MATCH (b:Supplier {s_name: 'Supplier#000000005'}) REDIRECT EDGES FROM a TO b WHERE type(r) IN ['SUPPLIES'] DIRECTION OUTGOING",
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN id(s) AS s, id(p) AS p",
        "SELECT DISTINCT CASE WHEN l_suppkey = 2 THEN 5 ELSE l_suppkey END AS s, l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey",
    ),
    "text_detach_document": (
        "MATCH (s:Supplier) SET s.info = {balance: s.s_acctbal, name: s.s_name} DETACH DOCUMENT s.info AS (i:Info)<-[:HAS_INFO]-(s)",
        "MATCH (s:Supplier)-[:HAS_INFO]->(i:Info) RETURN id(s) AS id, i.balance AS balance, i.name AS name, s.info IS NULL AS gone",
        "SELECT s_suppkey AS id, s_acctbal AS balance, s_name AS name, TRUE AS gone FROM supplier",
    ),
    "text_attach_document": (
        "ATTACH (n:Nation)<-[:BASED_IN]-(s:Supplier) INTO s.home",
        "MATCH (s:Supplier) RETURN id(s) AS id, s.home.n_name AS home",
        "SELECT s_suppkey AS id, n_name AS home FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
    ),
}


def _write(name: str) -> Callable[[SparkSession, str], DataFrame]:
    statement, query, _ = WRITES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Graph(star_graph(spark, sf_dir)).write(statement).graph.query(query)

    run.__name__ = name
    run.__doc__ = statement
    return run


_SCORES = f"SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS a FROM embeddings"
graph_text("rrf_in_text", "MATCH (v:Vec) RETURN id(v) AS id, round(rrf_score([v.embedding], {vector: $q}) * 1000000) AS score", f"WITH s AS ({_SCORES}) SELECT id, round(1000000.0::DOUBLE / (60 + rank() OVER (ORDER BY a DESC))) AS score FROM s", q=_Q)
graph_text("cc_in_text", "MATCH (v:Vec) RETURN id(v) AS id, round(cc_score([v.embedding], {vector: $q}, {vector: 0.7, text: 0.3}) * 100000) AS score", f"WITH s AS ({_SCORES}) SELECT id, round(0.7 * (a - (SELECT min(a) FROM s)) / (SELECT max(a) - min(a) FROM s) * 100000) AS score FROM s", q=_Q)
graph_text("dbsf_in_text", "MATCH (v:Vec) WITH id(v) AS id, dbsf_score([v.embedding], {vector: $q}, {vector: 2.0}) AS s RETURN id, round(s * 100000) AS score", f"WITH s AS ({_SCORES}) SELECT id, round(2 * (a - (SELECT avg(a) FROM s)) / (SELECT stddev_pop(a) FROM s) * 100000) AS score FROM s", q=_Q)
graph_text("doc_score_in_text", "MATCH (d:Document) RETURN id(d) AS id, round(doc_score(d, $q) * 100000) AS score", f"WITH c AS (SELECT vec_id % 50 AS d, list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS s FROM embeddings), g AS (SELECT d, greatest(max(s), 0) AS m, avg(s) AS a, sum((s > 0)::INT) / count(*) AS k FROM c GROUP BY d) SELECT doc_id AS id, round(CASE WHEN d IS NULL THEN 0 ELSE 0.5 * m + 0.3 * a + 0.2 * k END * 100000)::DOUBLE AS score FROM documents LEFT JOIN g ON d = doc_id", q=_Q)
graph_text("hybrid_in_text", "MATCH (v:Vec) WHERE vector_distance(v.embedding, $q) < 1.1 RETURN id(v) AS id, round(hybrid_score(v, '') * 100000) AS score", f"WITH s AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS d FROM embeddings) SELECT id, round(0.65::DOUBLE / (1 + d) * 100000) AS score FROM s WHERE d < 1.1", q=_Q)
graph_text("regex_bad_pattern", "MATCH (n:Nation) WHERE NOT n.n_name =~ '(' RETURN count(*) AS n", "SELECT count(*) AS n FROM nation")


#: name -> (function, SQL)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def registered(sql: str | None):
    def add(f):
        OTHERS[f.__name__] = (f, sql)
        return f

    return add


@registered(_bm25(["der", "und"]).replace("GROUP BY id", "GROUP BY id HAVING count(*) = 2"))
def text_boolean(spark, sf_dir):
    """Both terms."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.search(docs, "der AND und").select("id", F.round(F.col("score") * 100000).alias("score"))


@registered(rf"SELECT doc_id AS id FROM documents WHERE ' ' || array_to_string({_TOKENS}, ' ') || ' ' LIKE '% general public license %'")
def text_phrase(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.search(docs, '"general public license"').select("id")


@registered(rf"SELECT doc_id AS id FROM documents WHERE len(list_filter({_TOKENS}, lambda x: x LIKE 'licen%')) > 0")
def text_prefix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.search(docs, "licen*").select("id")


@registered(rf"SELECT doc_id AS id FROM documents WHERE len(list_filter({_TOKENS}, lambda x: levenshtein(x, 'licence') <= 1)) > 0")
def text_fuzzy(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.search(docs, "licence", fuzzy=True).select("id")


@registered(rf"SELECT w AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents) GROUP BY 1")
def text_postings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return text.postings(docs).groupBy("term").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("docs"))


def _scored(spark, sf_dir):
    q = F.array(*map(F.lit, _Q))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(vector.vector_similarity(F.col("embedding"), q), 6).alias("a"), F.when(F.col("label") < 5, F.col("label").cast("double")).alias("b"))


_SCORED = f"s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS a, CASE WHEN label < 5 THEN label::DOUBLE END AS b FROM embeddings)"


@registered(f"WITH {_SCORED}, r AS (SELECT id, rank() OVER (ORDER BY a DESC) AS ra, CASE WHEN b IS NOT NULL THEN rank() OVER (ORDER BY b DESC NULLS LAST) ELSE (SELECT count(b) + 1 FROM s) END AS rb FROM s) SELECT id, round((1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb)) * 1000000) AS score FROM r")
def rank_fusion_rrf(spark, sf_dir):
    return fusion.rrf(_scored(spark, sf_dir), ["a", "b"]).select("id", F.round(F.col("rrf_score") * 1000000).alias("score"))


@registered(f"WITH {_SCORED} SELECT id, round((0.7 * (a - (SELECT min(a) FROM s)) / (SELECT max(a) - min(a) FROM s) + 0.3 * coalesce((b - (SELECT min(b) FROM s)) / (SELECT max(b) - min(b) FROM s), 0)) * 100000) AS score FROM s")
def rank_fusion_convex(spark, sf_dir):
    return fusion.convex(_scored(spark, sf_dir), {"a": 0.7, "b": 0.3}).select("id", F.round(F.col("cc_score") * 100000).alias("score"))


@registered(f"WITH {_SCORED} SELECT id, round((0.7 * (a - (SELECT avg(a) FROM s)) / (SELECT stddev_pop(a) FROM s) + 0.3 * coalesce((b - (SELECT avg(b) FROM s)) / (SELECT stddev_pop(b) FROM s), 0)) * 100000) AS score FROM s")
def rank_fusion_dbsf(spark, sf_dir):
    return fusion.dbsf(_scored(spark, sf_dir), {"a": 0.7, "b": 0.3}).select("id", F.round(F.col("dbsf_score") * 100000).alias("score"))


@registered(f"WITH c AS (SELECT vec_id % 50 AS d, list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS s FROM embeddings), g AS (SELECT d, greatest(max(s), 0) AS m, avg(s) AS a, sum((s > 0)::INT) / count(*) AS k FROM c GROUP BY d) SELECT doc_id AS id, round(CASE WHEN d IS NULL THEN 0 ELSE 0.5 * m + 0.3 * a + 0.2 * k END * 100000)::DOUBLE AS score FROM documents LEFT JOIN g ON d = doc_id")
def doc_score(spark, sf_dir):
    q = F.array(*map(F.lit, _Q))
    chunks = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("id"), vector.vector_similarity(F.col("embedding"), q).alias("sim"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return fusion.doc_score(docs, chunks, "sim").select("id", F.round(F.col("doc_score") * 100000).alias("score"))


_POINTS = "p AS (SELECT c_custkey AS id, (c_custkey * 37 % 170) - 85.0 AS latitude, (c_custkey * 53 % 350) - 175.0 AS longitude FROM customer)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 170 - F.lit(85.0)).alias("latitude"), (k * 53 % 350 - F.lit(175.0)).alias("longitude"))


_METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(48.0) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(48.0)) * pow(sin((radians(11.0) - radians(longitude)) / 2), 2))))"


@registered(f"WITH {_POINTS} SELECT id, round({_METRES}) AS metres FROM p WHERE {_METRES} < 2000000")
def spatial_radius(spark, sf_dir):
    return spatial.within_radius(_points(spark, sf_dir), 48.0, 11.0, 2_000_000).select("id", F.round("metres").alias("metres"))


@registered(f"WITH {_POINTS} SELECT id, latitude::DOUBLE AS latitude FROM p WHERE latitude BETWEEN 10 AND 40 AND (longitude >= 160 OR longitude <= -150)")
def spatial_box(spark, sf_dir):
    return spatial.within_box(_points(spark, sf_dir), 10, 160, 40, -150).select("id", "latitude")


@registered(f"WITH {_POINTS} SELECT id, round({_METRES}) AS metres FROM p ORDER BY {_METRES}, id LIMIT 15")
def spatial_nearest(spark, sf_dir):
    return spatial.nearest(_points(spark, sf_dir), 48.0, 11.0, 15).select("id", F.round("metres").alias("metres"))


@registered("SELECT user_id AS meta, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket, count(*) AS n, min(value) AS lo, max(value) AS hi, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY 1, 2")
def timeseries_buckets(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("meta"), "ts", "value")
    out = timeseries.buckets(ev, ["value"])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("meta", us("bucket").alias("bucket"), "n", F.col("value_min").alias("lo"), F.col("value_max").alias("hi"), us("first_ts").alias("first"), us("last_ts").alias("last"))


@registered("SELECT user_id AS meta, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS bucket FROM events")
def timeseries_rollover(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("meta"), "ts", F.col("event_id").alias("seq"))
    return timeseries.rollover(ev, 10, order=["ts", "seq"]).select("meta", "seq", "bucket")


@registered("SELECT user_id AS meta, arg_max(value, (ts, event_id)) AS value, count(*) AS versions FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def timeseries_as_of(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("meta"), "ts", "value", "event_id")
    return timeseries.as_of(ev, F.lit("2024-01-15").cast("timestamp_ntz"), by=["meta"], order=["ts", "event_id"], keep=["value"]).select("meta", "value", "versions")


@registered("SELECT event_id AS id, round(greatest(0, 1 - (1706659200 - epoch(ts)) / 1209600.0) * 100000)::DOUBLE AS linear, round(pow(0.5, (1706659200 - epoch(ts)) / 604800.0) * 100000)::DOUBLE AS half, round(pow(1 + (1706659200 - epoch(ts)) / 604800.0, -1.0) * 100000)::DOUBLE AS power FROM events")
def computed_decay(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    age = F.lit(1706659200.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    r = lambda c: F.round(c * 100000)
    return ev.select(F.col("event_id").alias("id"), r(decay.linear(age, 1209600)).alias("linear"), r(decay.exponential(age, 604800)).alias("half"), r(decay.power_law(age, 604800, 1.0)).alias("power"))


@registered("SELECT event_id AS id, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def ttl_nodes(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts")
    return decay.expire_nodes(ev, F.col("ts").cast("timestamp"), 10 * 86400, F.lit("2024-01-30").cast("timestamp")).select("id", "kind")


@registered("SELECT event_id AS id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN props END AS props, true AS anchored FROM events")
def ttl_subtree(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "props")
    left, _ = decay.reap(ev, {}, "ts", 10 * 86400, F.lit("2024-01-30").cast("timestamp"), "subtree", "props")
    return left.select("id", "props", F.col("ts").isNotNull().alias("anchored"))


@registered("SELECT event_id AS id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN epoch_us(ts) END AS at FROM events")
def ttl_field(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    left, _ = decay.reap(ev, {}, "ts", 10 * 86400, F.lit("2024-01-30").cast("timestamp"), "field")
    return left.select("id", F.unix_micros("ts").alias("at"))


@registered("SELECT user_id AS src, event_id AS dst FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def ttl_edges(spark, sf_dir):
    """The edges left when events expire with theirs."""
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    raised = ev.select(F.col("user_id").alias("src"), F.col("id").alias("dst"))
    return decay.reap(ev, {"RAISED": (raised, False, True)}, "ts", 10 * 86400, F.lit("2024-01-30").cast("timestamp"))[1]["RAISED"]


def _people(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("long").alias("nation"))


@registered("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def create_nodes(spark, sf_dir):
    new = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return mutate.create_nodes(_people(spark, sf_dir).select("id", "name"), new, order=["name"])


@registered("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS balance, CASE WHEN s_acctbal < 0 THEN 'low' END AS mark FROM supplier")
def set_properties(spark, sf_dir):
    return mutate.set_properties(_people(spark, sf_dir).select("id", "balance"), F.col("balance") < 0, {"balance": F.lit(0.0), "mark": F.lit("low")})


@registered("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal >= 0")
def detach_delete(spark, sf_dir):
    people = _people(spark, sf_dir)
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes, _ = mutate.delete_nodes(people, {"SUPPLIES": (edges, True, False)}, people.where("balance < 0").select("id"), detach=True)
    return nodes.select("id", "name")


@registered("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def detach_delete_edges(spark, sf_dir):
    people = _people(spark, sf_dir)
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    _, out = mutate.delete_nodes(people, {"SUPPLIES": (edges, True, False)}, people.where("balance < 0").select("id"), detach=True)
    return out["SUPPLIES"]


@registered("WITH s AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT s_name FROM supplier WHERE s_suppkey <= 5), m AS (SELECT max(s_suppkey) AS m FROM supplier) SELECT s_suppkey AS id, s_name AS name, s_name IN (SELECT name FROM s) AS seen FROM supplier UNION ALL SELECT m + row_number() OVER (ORDER BY name), name, NULL FROM s, m WHERE name NOT IN (SELECT s_name FROM supplier)")
def merge_nodes_by_key(spark, sf_dir):
    people = _people(spark, sf_dir).select("id", "name")
    wanted = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(people.where("id <= 5").select("name"))
    return mutate.merge(people.withColumn("seen", F.lit(False)), wanted, ["name"], on_match={"seen": F.lit(True)})


@registered("SELECT DISTINCT CASE WHEN l_suppkey IN (2, 3) THEN 1 ELSE l_suppkey END AS src, l_partkey AS dst FROM lineitem")
def merge_nodes_edges(spark, sf_dir):
    people = _people(spark, sf_dir)
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    _, out = mutate.merge_nodes(people, {"SUPPLIES": (edges, True, False)}, {2: 1, 3: 1})
    return out["SUPPLIES"]


@registered("SELECT s_suppkey AS id, CASE WHEN s_suppkey = 1 THEN (SELECT s_name FROM supplier WHERE s_suppkey = 3) ELSE s_name END AS name FROM supplier WHERE s_suppkey NOT IN (2, 3)")
def merge_nodes_last(spark, sf_dir):
    nodes, _ = mutate.merge_nodes(_people(spark, sf_dir), {}, {2: 1, 3: 1}, keep="last")
    return nodes.select("id", "name")


@registered("WITH m AS (SELECT max(s_suppkey) AS m FROM supplier) SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT m + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier, m WHERE s_suppkey IN (4, 9)")
def clone_nodes(spark, sf_dir):
    nodes, _ = mutate.clone_nodes(_people(spark, sf_dir), {}, [4, 9])
    return nodes.select("id", "name")


@registered("SELECT DISTINCT CASE WHEN l_suppkey = 2 THEN 5 ELSE l_suppkey END AS src, l_partkey AS dst FROM lineitem")
def redirect_edges(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return mutate.redirect_edges(edges, 2, 5, "out")


@registered("SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def detach_document(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k long").alias("doc"))
    _, docs, edges = mutate.detach_document(ev, "doc")
    return edges.join(docs.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "k")


@registered("SELECT n_nationkey::BIGINT AS id, n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def attach_document(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", F.col("n_regionkey").cast("long").alias("r"))
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), "r_name")
    out = mutate.attach_document(nation.select("id", "n_name"), region, nation.select(F.col("id").alias("src"), F.col("r").alias("dst")), "doc")
    return out.select("id", "n_name", F.col("doc.r_name").alias("region"))


@registered("SELECT event_id AS id, list_transform(list_filter([1, 2, 3, event_id % 3], lambda x: x <> 2), lambda x: x)::BIGINT[]::VARCHAR AS tags, 1 + event_id AS hits FROM events")
def document_updates(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>").alias("tags"), F.lit(None).cast("long").alias("hits"))
    ev = ev.withColumn("tags", mutate.doc_pull(mutate.doc_push(F.col("tags"), F.col("id") % 3), F.lit(2)))
    return ev.select("id", F.concat(F.lit("["), F.array_join(F.col("tags").cast("array<string>"), ", "), F.lit("]")).alias("tags"), mutate.doc_inc(F.col("hits"), 1 + F.col("id")).alias("hits"))


@registered("SELECT s_suppkey AS id FROM supplier WHERE s_name = 'Supplier#000000007'")
def encrypted_match(spark, sf_dir):
    """Equality on keyed tokens: the rows whose plain value it is."""
    people = _people(spark, sf_dir)
    return mutate.encrypted_equal(people, "name", "Supplier#000000007", b"key").select("id")


@registered("SELECT * FROM (VALUES ('cartesian product'), ('missing index'), ('unbounded traversal')) t(detector)")
def advisor_suggestions(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    found = advisor.suggestions(g, "MATCH (a:Part {p_size: 1})-[:PARENT*]->(b), (c:Customer) RETURN count(*)")
    return spark.createDataFrame([(f["detector"],) for f in found], "detector string")


@registered("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 40")
def keyset_page(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return timeseries.page(part, "id", 100, 40)


QUERIES = {**{n: _run(n) for n in TEXTS}, **{n: _write(n) for n in WRITES}, **{n: f for n, (f, _) in OTHERS.items()}}
ORACLES = {**{n: s for n, (_, s, _) in TEXTS.items() if s}, **{n: s for n, (_, _, s) in WRITES.items()}, **{n: s for n, (_, s) in OTHERS.items() if s}}
