import pytest

from docloom.operators import graph

EDGES = [("a", "b", "controls", 0, ""), ("b", "c", "requires", 1, "x"), ("c", "a", "next", 2, ""), ("a", "c", "controls", 3, ""), ("d", "d", "next", 4, ""), ("a", "b", "next", 5, "")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, rel string, ord long, guard string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_collapse_keeps_the_last(edges):
    assert ("a", "b", "next") in [r[:3] for r in rows(graph.collapse(edges))]


def test_expand(spark, edges):
    seeds = spark.createDataFrame([("b",)], "seed string")
    assert rows(graph.expand(edges, seeds, 1)) == [("b", "a", 1, "controls"), ("b", "c", 1, "requires")]
    assert rows(graph.expand(edges, seeds, 2, direction="out")) == [("b", "a", 2, "next"), ("b", "c", 1, "requires")]
    assert rows(graph.expand(edges, seeds, 1, relations=("requires",))) == [("b", "c", 1, "requires")]
    wide = {r[:2] for r in rows(graph.expand(edges, seeds, 3))}
    assert {r[:2] for r in rows(graph.expand(edges, seeds, 2))} <= wide


def test_paths(spark, edges):
    pairs = spark.createDataFrame([("a", "c"), ("a", "a")], "start string, goal string")
    found = graph.simple_paths(edges, pairs)
    assert rows(found) == [("a", "c", ["a", "b", "c"], 2), ("a", "c", ["a", "c"], 1)]
    assert rows(graph.shortest_paths(found)) == [("a", "c", ["a", "c"], 1)]
    chain = graph.dependency_chain(edges, spark.createDataFrame([("a",)], "seed string"))
    assert rows(chain) == [("a", "b", 1, ["a", "b"]), ("a", "c", 1, ["a", "c"])]
    assert rows(graph.greedy_chain(edges, spark.createDataFrame([("a",)], "start string"))) == [("a", ["a", "b", "c"])]


def test_structure(spark, edges):
    nodes = spark.createDataFrame([("e",)], "node string")
    got = {r.node: (r.out_degree, r.in_degree, r.unreachable, r.deadlock) for r in graph.degrees(nodes, edges).collect()}
    assert got["a"] == (2, 1, False, False)
    assert got["e"] == (0, 0, True, True)
    assert rows(graph.strongly_connected(graph.closure(edges))) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert rows(graph.livelocks(edges)) == [("a", ["a", "c"], 2), ("d", ["d"], 1)]
    acyclic = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    assert rows(graph.levels(acyclic, spark.createDataFrame([("x",), ("y",), ("z",)], "node string"), 5)) == [("x", 0), ("y", 1), ("z", 2)]


def test_enrich_and_names(spark, edges):
    new = spark.createDataFrame([("a", "b", "controls", 0.6), ("a", "z", "controls", 0.6), ("a", "z", "controls", 0.6)], "src string, dst string, rel string, weight double")
    assert rows(graph.enrich(edges.select("src", "dst", "rel"), new)) == [("a", "z", "controls", 0.6)]
    names = spark.createDataFrame([("door",), ("lock",), ("none",)], "name string")
    entities = spark.createDataFrame([(1, "Door"), (2, "DoorLock"), (3, "LockAll")], "entity_id int, name string")
    assert rows(graph.resolve_names(names, entities)) == [("door", 1, "exact"), ("lock", 2, "substring")]
