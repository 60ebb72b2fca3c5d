"""Queries on graphs, rules and state machines, over the foreign keys of the star schema and the events' state changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import graph
from docloom.operators.enrich import rule_relevance
from docloom.operators.search import ranked
from docloom.plans.registry import Tables, query

#: Nodes are r<region>, n<nation>, c<customer>, s<supplier>; edges follow the foreign keys.
_EDGES = "edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'belongs_to' AS rel, n_nationkey AS ord FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', 1000 + c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'depends_on', 100000000 + s_suppkey FROM supplier)"


def _key(prefix: str, c: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _edges(t: Tables) -> DataFrame:
    n = t.nation.select(_key("n", "n_nationkey").alias("src"), _key("r", "n_regionkey").alias("dst"), F.lit("belongs_to").alias("rel"), F.col("n_nationkey").cast("long").alias("ord"))
    c = t.customer.select(_key("c", "c_custkey").alias("src"), _key("n", "c_nationkey").alias("dst"), F.lit("located_in").alias("rel"), (F.col("c_custkey") + 1000).cast("long").alias("ord"))
    s = t.supplier.select(_key("s", "s_suppkey").alias("src"), _key("n", "s_nationkey").alias("dst"), F.lit("depends_on").alias("rel"), (F.col("s_suppkey") + 100000000).cast("long").alias("ord"))
    return n.unionByName(c).unionByName(s)


def _nations(t: Tables) -> DataFrame:
    return t.nation.select(_key("n", "n_nationkey").alias("seed"))


_BOTH = "both_ways AS (SELECT src AS a, dst AS b, rel, 0 AS way, ord FROM edges UNION ALL SELECT dst, src, rel, 1, ord FROM edges)"
_HOP1 = "seeds AS (SELECT 'n' || n_nationkey AS seed FROM nation), h1 AS (SELECT seed, b AS node, 1 AS distance, arg_min(rel, way * 1e12 + ord) AS rel FROM seeds JOIN both_ways ON a = seed WHERE b <> seed GROUP BY 1, 2)"


@query(f"WITH {_EDGES}, {_BOTH}, {_HOP1} SELECT seed, node, distance, rel FROM h1")
def graph_expand_1hop(t: Tables) -> DataFrame:
    return graph.expand(_edges(t), _nations(t), 1)


@query(f"WITH {_EDGES}, {_BOTH}, rs AS (SELECT 'r' || r_regionkey AS seed FROM region), h1 AS (SELECT seed, b AS node, 1 AS distance, arg_min(rel, way * 1e12 + ord) AS rel FROM rs JOIN both_ways ON a = seed GROUP BY 1, 2), h2 AS (SELECT h.seed, w.b AS node, 2 AS distance, arg_min(w.rel, w.way * 1e12 + w.ord) AS rel FROM h1 h JOIN both_ways w ON w.a = h.node WHERE w.b <> h.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h.seed AND x.node = w.b) GROUP BY 1, 2) SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def graph_expand_2hop(t: Tables) -> DataFrame:
    return graph.expand(_edges(t), t.region.select(_key("r", "r_regionkey").alias("seed")), 2)


@query("WITH e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), a AS (SELECT 's' || s_suppkey AS seed FROM supplier) SELECT seed, dst AS node, 1 AS depth, seed || '>' || dst AS path FROM a JOIN e ON src = seed UNION ALL SELECT seed, f.dst, 2, seed || '>' || e.dst || '>' || f.dst FROM a JOIN e ON e.src = seed JOIN e f ON f.src = e.dst")
def dependency_chain(t: Tables) -> DataFrame:
    e = _edges(t).where("rel <> 'located_in'").withColumn("rel", F.lit("depends_on"))
    out = graph.dependency_chain(e, t.supplier.select(_key("s", "s_suppkey").alias("seed")), 3)
    return out.select("seed", "node", "depth", F.array_join("path", ">").alias("path"))


@query(f"WITH {_EDGES}, ids AS (SELECT 'r' || r_regionkey AS id FROM region) SELECT DISTINCT src, dst, rel FROM edges WHERE src IN (SELECT id FROM ids) OR dst IN (SELECT id FROM ids)")
def subgraph_any_endpoint(t: Tables) -> DataFrame:
    return graph.subgraph(_edges(t), t.region.select(_key("r", "r_regionkey").alias("id"))).select("src", "dst", "rel")


@query(f"WITH {_EDGES}, d AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT src AS node FROM d UNION SELECT dst FROM d), o AS (SELECT src AS node, count(*) AS k FROM d GROUP BY 1), i AS (SELECT dst AS node, count(*) AS k FROM d GROUP BY 1) SELECT node, coalesce(o.k, 0)::BIGINT AS out_degree, coalesce(i.k, 0)::BIGINT AS in_degree, i.k IS NULL AS unreachable, o.k IS NULL AS deadlock FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node)")
def degree_unreachable_deadlock(t: Tables) -> DataFrame:
    e = _edges(t)
    return graph.degrees(e.select(F.col("src").alias("node")).distinct(), e)


@query(f"WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT seed, dst, depth + 1 FROM r JOIN d ON src = node WHERE depth < 3) SELECT seed, node, min(depth)::INT AS depth FROM r WHERE depth > 0 GROUP BY 1, 2")
def impact_closure(t: Tables) -> DataFrame:
    return graph.impact(_edges(t), t.customer.select(_key("c", "c_custkey").alias("seed")), 3)


_TRANS = "tr AS (SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2)"


def _transitions(t: Tables) -> DataFrame:
    return graph.state_transitions(t.events, "user_id", "event_type", ["ts", "event_id"])


@query(f"WITH {_TRANS} SELECT src, dst, n FROM tr")
def state_transitions_events(t: Tables) -> DataFrame:
    return _transitions(t)


_WALK = "WITH RECURSIVE " + _TRANS + ", e AS (SELECT src, dst FROM tr WHERE src <> dst), w AS (SELECT src AS s, dst AS node, [src, dst] AS path, 1 AS hops FROM e UNION ALL SELECT s, dst, list_append(path, dst), hops + 1 FROM w JOIN e ON src = node WHERE NOT list_contains(path, dst) AND hops < 4)"


def _pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = graph.stored(_transitions(t).where("src <> dst").select("src", "dst"))
    states = e.select(F.col("src").alias("start")).distinct()
    return e, states.crossJoin(states.select(F.col("start").alias("goal"))).where("start <> goal")  # a handful of states


@query(_WALK + " SELECT s AS start, node AS goal, array_to_string(path, '>') AS path, hops FROM w")
def simple_paths(t: Tables) -> DataFrame:
    return graph.simple_paths(*_pairs(t), 4).select("start", "goal", F.array_join("path", ">").alias("path"), "hops")


@query(_WALK + ", r AS (SELECT *, row_number() OVER (PARTITION BY s, node ORDER BY hops, path) AS k FROM w) SELECT s AS start, node AS goal, array_to_string(path, '>') AS path, hops FROM r WHERE k = 1")
def shortest_path(t: Tables) -> DataFrame:
    return graph.shortest_paths(graph.simple_paths(*_pairs(t), 4)).select("start", "goal", F.array_join("path", ">").alias("path"), "hops")


@query("WITH RECURSIVE " + _TRANS + ", r AS (SELECT src, dst, 1 AS d FROM tr UNION SELECT r.src, tr.dst, d + 1 FROM r JOIN tr ON tr.src = r.dst WHERE d < 5) SELECT src AS seed, dst AS node, min(d)::INT AS distance FROM r WHERE src <> dst GROUP BY 1, 2")
def bfs_min_depth(t: Tables) -> DataFrame:
    e = _transitions(t).withColumn("rel", F.lit("next")).withColumn("ord", F.col("n"))
    return graph.expand(e, e.select(F.col("src").alias("seed")).distinct(), 5, direction="out").select("seed", "node", "distance")


@query("WITH RECURSIVE " + _TRANS + ", r AS (SELECT src, dst FROM tr UNION SELECT r.src, tr.dst FROM r JOIN tr ON tr.src = r.dst), m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) SELECT src AS node, min(least(src, dst)) AS component FROM m GROUP BY 1")
def scc_pairs(t: Tables) -> DataFrame:
    return graph.strongly_connected(graph.closure(_transitions(t)))


@query("WITH RECURSIVE " + _TRANS + ", e AS (SELECT src, dst FROM tr WHERE n % 2 = 0), w AS (SELECT src AS s, dst AS node, [src, dst] AS path, 1 AS hops FROM e WHERE src <> dst UNION ALL SELECT s, dst, list_append(path, dst), hops + 1 FROM w JOIN e ON src = node WHERE NOT list_contains(path, dst) AND hops < 4) SELECT w.s AS start, array_to_string(path, '>') AS path, hops + 1 AS hops FROM w JOIN e ON e.src = w.node AND e.dst = w.s WHERE s = list_min(path) UNION ALL SELECT src, src, 1 FROM e WHERE src = dst")
def livelock_cycles(t: Tables) -> DataFrame:
    e = graph.stored(_transitions(t).withColumn("guard", F.when(F.col("n") % 2 == 0, "").otherwise("x")))
    return graph.livelocks(e, 5).select("start", F.array_join("path", ">").alias("path"), "hops")


@query("WITH g AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS guard FROM events) SELECT src, dst, count(*) AS n, array_to_string(list_sort(list_distinct(list(guard))), ',') AS guards FROM g WHERE dst IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_transitions(t: Tables) -> DataFrame:
    nxt = F.expr("lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    e = t.events.select(F.col("event_type").alias("src"), nxt.alias("dst"), F.when(F.col("value") > 50, "high").otherwise("low").alias("guard")).where("dst is not null")
    return graph.duplicate_transitions(e).select("src", "dst", "n", F.array_join("guards", ",").alias("guards"))


@query("SELECT lower(n_name) AS term, n_nationkey AS entity_id, n_name AS name FROM nation")
def entity_exact_lookup(t: Tables) -> DataFrame:
    entities = t.nation.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    return graph.lookup_entities(entities, t.nation.select(F.lower("n_name").alias("term")))


@query("WITH names AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE substr(n_name, 2, 4) END AS name FROM nation), x AS (SELECT name, min(n_nationkey) AS entity_id FROM names JOIN nation ON lower(n_name) = lower(name) GROUP BY 1) SELECT name, entity_id, 'exact' AS tier FROM x UNION ALL SELECT name, min(n_nationkey), 'substring' FROM names JOIN nation ON contains(lower(n_name), lower(name)) WHERE name NOT IN (SELECT name FROM x) GROUP BY 1")
def two_tier_lookup(t: Tables) -> DataFrame:
    names = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.substring("n_name", 2, 4)).alias("name")).distinct()
    return graph.resolve_names(names, t.nation.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name")))


@query("WITH m AS (SELECT p_partkey AS rule_id, p_type AS module, 2 * contains(lower(p_name || ' ' || p_brand), 'widget')::INT + contains(lower(p_name || ' ' || p_brand), 'a')::INT + 3 * (p_type = 'PROMO')::INT AS s FROM part), t AS (SELECT *, row_number() OVER (ORDER BY s DESC, rule_id) AS k FROM m WHERE s > 0), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY k) AS n FROM t WHERE k <= 8) SELECT module, rule_id, s AS score, n AS rank FROM r WHERE n <= 3")
def rules_top3_per_module(t: Tables) -> DataFrame:
    """The best eight rules of one question, then at most three of each module."""
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("module"), F.col("p_name").alias("condition"), F.col("p_brand").alias("action"))
    asked = "query_id int, modules array<string>, signals array<string>, states array<string>, functions array<string>, keywords array<string>"
    best = rule_relevance(rules, t.spark.createDataFrame([(1, ["PROMO"], ["widget"], [], [], ["a"])], asked))
    return ranked(best.withColumn("score_", F.col("score")).withColumn("score", -F.col("rank")), 3, by="module", tie="rule_id").select("module", "rule_id", F.col("score_").alias("score"), "rank")


@query("WITH q AS (SELECT DISTINCT p_type AS query_id FROM part), m AS (SELECT query_id, p_partkey AS rule_id, p_type AS module, 3 * (p_type = query_id)::INT + 2 * contains(lower(p_name || ' ' || p_brand), 'co')::INT + contains(lower(p_name || ' ' || p_brand), 'a')::INT + contains(lower(p_name || ' ' || p_brand), 'e')::INT AS score FROM q, part), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id) AS rank FROM m WHERE score > 0) SELECT query_id, rule_id, module, score, rank FROM r WHERE rank <= 8")
def rule_match_score(t: Tables) -> DataFrame:
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("module"), F.col("p_name").alias("condition"), F.col("p_brand").alias("action"))
    none = F.array().cast("array<string>")
    asked = t.part.select(F.col("p_type").alias("query_id")).distinct()
    intents = asked.select("query_id", F.array("query_id").alias("modules"), F.array(F.lit("co")).alias("signals"), none.alias("states"), none.alias("functions"), F.array(F.lit("a"), F.lit("e")).alias("keywords"))
    return rule_relevance(rules, intents)
