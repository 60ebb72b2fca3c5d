"""What rules and machines say about questions, on tables small enough to read."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation, explain, graph
from docloom.plans.retrieval import search_terms

QUESTIONS = [
    (1, "从Abandoned如何进入Driving?"), (2, "PEPS_Mode 失效的影响"), (3, "优先级冲突"), (4, "deadlock?"), (5, "Which rule sends Lamp_Out?"), (6, "nothing at all"), (7, None), (8, ""),
]


@pytest.fixture(scope="module")
def tables(spark):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    named = spark.createDataFrame([(2, 0, "fault", "mode"), (2, 1, "signal", "PEPS_Mode"), (6, 0, "signal", "Other")], "query_id long, nth int, entity_type string, name string")
    entities = spark.createDataFrame([("e1", "signal", "PEPS_Mode"), ("e2", "module", "Lamp_Out"), (None, None, None)], "entity_id string, entity_type string, name string")
    rules = spark.createDataFrame(
        [("r1", "Lamp", "output", "PEPS_Mode = 1", "set Lamp_Out", "2.1", None), ("r2", "Lamp", None, None, "send Lamp_Out", None, ["PEPS_Mode on"]), ("r3", None, None, None, None, None, None)],
        "rule_id string, module string, rule_type string, condition string, action string, section_path string, preconditions array<string>",
    )
    states = spark.createDataFrame([("P", "Abandoned", True, False), ("P", "Inactive", False, False), ("P", "Driving", False, True), ("P", "Lost", None, None), ("Q", "Driving", False, False)], "module string, name string, is_initial boolean, is_terminal boolean")
    moves = spark.createDataFrame(
        [("Abandoned", "Inactive", "PEPS_Mode = 1", "P", 1), ("Inactive", "Driving", None, "P", 2), ("Inactive", "Driving", "later", "P", 3), ("Inactive", "Abandoned", "x y", "P", 4)],
        "src string, dst string, guard string, module string, ord long",
    )
    return questions, named, entities, rules, states, moves


def lines(df, query):
    return [(r.part, r.head, r.line) for r in sorted(df.where(f"query_id = {query}").collect(), key=lambda r: (explain.PARTS.index(r.part), r.nth))]


def test_all_parts(tables):
    questions, named, entities, rules, states, moves = tables
    got = explain.explain(questions, named, search_terms(questions), entities, rules, states, moves)
    assert {(r.query_id, r.part) for r in explain.wanted_parts(questions, named).collect()} == {
        (1, "state_machine"), (1, "rule"), (1, "path"), (2, "impact"), (3, "conflict"), (4, "reachability"), (5, "rule"),
    }
    assert [x for x in lines(got, 1) if x[0] == "path"] == [
        ("path", "P: Abandoned → Driving (2 hops)", "Path: Abandoned → Inactive → Driving"),
        ("path", "P: Abandoned → Driving (2 hops)", "Abandoned → Inactive: PEPS_Mode = 1"),
        ("path", "P: Abandoned → Driving (2 hops)", "Inactive → Driving: "),
    ]
    assert ("state_machine", "P: Abandoned to", "Guard: PEPS_Mode = 1") in lines(got, 1)
    assert lines(got, 2) == [
        ("impact", "PEPS_Mode (signal)", x)
        for x in ("Directly affects 2 rules", "[output] set Lamp_Out", "[] send Lamp_Out", "Affected modules: Lamp", "Affected signals: Lamp_Out", "P: Abandoned → Inactive guarded by PEPS_Mode")
    ]
    assert [x[2] for x in lines(got, 3)] == ["→ Driving [Guard: ]", "→ Driving [Guard: later]", "→ Abandoned [Guard: x y]", "Guards appear mutually exclusive"]
    assert [x[1:] for x in lines(got, 4)] == [
        ("P", "States: 4, Transitions: 4"), ("P", "Unreachable states: Lost"), ("P", "Deadlock states: Lost"), ("P", "Connected component: Abandoned, Driving, Inactive (3 states)"),
        ("Q", "States: 1, Transitions: 0"), ("Q", "Unreachable states: Driving"), ("Q", "Deadlock states: Driving"),
    ]
    assert [x[2] for x in lines(got, 5)] == ["[output] [2.1]", "IF: PEPS_Mode = 1", "THEN: set Lamp_Out", "[] []", "THEN: send Lamp_Out"]
    assert not lines(got, 6) and not lines(got, 7) and not lines(got, 8)
    text = {r.query_id: r.text for r in explain.explained(got).collect()}
    assert text[5] == "## Rule\n### Lamp (2 rules)\n- [output] [2.1]\n- IF: PEPS_Mode = 1\n- THEN: set Lamp_Out\n- [] []\n- THEN: send Lamp_Out"


def test_empty_tables(tables):
    empty = [t.limit(0) for t in tables]
    assert explain.explain(tables[0], tables[1], search_terms(tables[0]), *empty[2:]).count() == 0
    assert explain.explain(empty[0], empty[1], search_terms(empty[0]), *tables[2:]).count() == 0


def test_routes(spark):
    """Shortest, then first by name; cycles, unreachable goals and pairs of equal ends."""
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("d", "e")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "e"), ("e", "a"), ("a", "a"), ("d", "b"), ("a", "d")], "start string, goal string")
    got = {(r.start, r.goal): (r.path, r.hops) for r in graph.routes(edges, pairs).collect()}
    assert got == {("a", "d"): (["a", "b", "d"], 2), ("a", "e"): (["a", "b", "d", "e"], 3), ("d", "b"): (["d", "a", "b"], 2)}
    assert {(r.start, r.goal) for r in graph.routes(edges, pairs, 2).collect()} == {("a", "d"), ("d", "b")}


def test_the_engine_explains(spark, tables):
    """Tables as ``analyse`` gives them: transitions have an id and no order, states may be absent."""
    from docloom.session import Engine

    _, _, _, rules, _, moves = tables
    entities = spark.createDataFrame([("e1", "signal", "PEPS_Mode", "P")], "entity_id string, entity_type string, name string, module string")
    chunks = spark.createDataFrame([], "chunk_id string, text string")
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    engine = Engine(spark)
    engine.load(chunks, entities, edges, rules=rules, transitions=moves.withColumnRenamed("ord", "id"), store=False)
    got = engine.explain(spark.createDataFrame([(1, "PEPS_Mode deadlock 的影响")], "query_id long, query string"))
    told = lines(got, 1)
    assert ("impact", "PEPS_Mode (signal)", "P: Abandoned → Inactive guarded by PEPS_Mode") in told
    assert ("reachability", "P", "Deadlock states: Driving") in told


def test_scores_without_expectations(spark):
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    none = words()
    row = spark.range(1).select(
        evaluation.guard_score(none, none, none, none, none, none).alias("a"), evaluation.guard_score(words("X = 1"), words("S"), words("2"), words("x", "X", "y"), words("S"), words("3")).alias("b"),
        evaluation.cause_score(none, none).alias("c"), evaluation.cause_score(words("the Bus", "off"), words("BUS OFF", "on")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (0.5, 0.5, 0.5, 0.5)
