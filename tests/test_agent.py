import base64

from pyspark.sql import functions as F

from docloom.operators import reasoning
from docloom.plans import agent, planner
from docloom.session import Engine
from docloom.sources import readers, sinks

DOC = """# 1 Exterior light

{}

# 2 Window control

{}
"""
LIGHT = "The PEPS_Mode signal wakes the lamp relay. " * 20 + "State Driving needs the Lamp_Relay."
WINDOW = "The window motor stops on overload and reports a fault. " * 20


def engine_of(spark, tmp_path):
    (tmp_path / "a.md").write_text(DOC.format(LIGHT, WINDOW))
    engine = Engine(spark)
    items = engine.parse(str(tmp_path / "*.md"))
    made = engine.analyse(items, "parsers-1")
    again = engine.analyse(engine.parse(str(tmp_path / "*.md")), "parsers-1")
    assert sorted(again["mentions"].inputFiles()) == sorted(made["mentions"].inputFiles())  # done once
    moves = spark.createDataFrame([("Inactive", "Driving", "PEPS_Mode = 1"), ("Driving", "Inactive", "")], "src string, dst string, guard string")
    engine.load(made["chunks"], made["entities"], made["edges"], rules=made["rules"], transitions=moves)
    return engine


def test_the_flow_of_the_readme(spark, tmp_path):
    """Parse, analyse, load, search, gather and ask, with nothing in between."""
    engine = engine_of(spark, tmp_path)
    questions = spark.createDataFrame([(1, "PEPS_Mode lamp"), (2, "window overload and unheard_of thing")], "query_id long, query string")
    best = {r.query_id: r for r in engine.search(questions).collect() if r.rank == 1}
    assert "PEPS_Mode" in best[1].text and "overload" in best[2].text and best[1].entity_hits > 0
    evidence, verdict = engine.gather(questions)
    got = {r.query_id: r for r in verdict.collect()}
    assert got[1].covered == 1 and got[1].gaps == [] and "unheard_of" in " ".join(got[2].gaps) or got[2].covered < 1
    assert evidence.count() == evidence.select("query_id", "source", "chunk_id").distinct().count()
    out = engine.ask("Driving 状态 死锁")
    assert out["template"] == "reachability_check" and "lamp" in out["answer"]
    tools = engine.tools(limit=2)
    assert tools.call("trace_path", start="Inactive", goal="Driving").count() == 1
    assert {r.direction for r in tools.call("query_state_machine", state="Driving").collect()} == {"incoming", "outgoing"}
    try:
        tools.call("check_reachability")
        raise AssertionError("a third call")
    except RuntimeError:
        assert [n for n, _ in tools.calls] == ["trace_path", "query_state_machine"]


def test_reflection(spark):
    ok, empty = spark.range(1), spark.range(0)
    plan = agent.plan_for("path_finding", ("intent", "path_finder", "chunk_search"))
    assert plan.nodes == ["intent", "path_finder", "chunk_search", "completeness"]
    fail = lambda p, given: spark.range(1).select(F.raise_error(F.lit("late")).alias("x"))
    out = planner.run_plan(plan, {"intent": lambda p, g: ok, "path_finder": fail, "chunk_search": lambda p, g: empty, "completeness": lambda p, g: ok})
    assert out["path_finder"].status == "failed" and "late" in out["path_finder"].error  # what fails at run time is recorded
    issues = agent.reflect(out, sufficient=False)
    assert issues == [("fail", "path_finder"), ("gap", "chunk_search"), ("quality", "completeness")]
    better = agent.augment(plan, issues)
    assert better.nodes == ["intent", "path_finder", "chunk_search", "state_machine", "completeness"]
    assert agent.augment(better, []) is better


def test_trees_and_chains(spark):
    moves = spark.createDataFrame([("Xa", "Xc", "Sig_One = 1", "m", 0), ("Xb", "Xc", "", "m", 1), ("Xc", "Xa", "", "m", 2)], "src string, dst string, guard string, module string, ord long")
    tree = {(tuple(r.path), r.kind, tuple(r.signals)) for r in reasoning.condition_tree(moves, spark.createDataFrame([("Xc",)], "goal string"), 4).collect()}
    assert tree == {(("Xc",), "OR", ()), (("Xc", "Xa"), "AND", ("Sig_One",)), (("Xc", "Xb"), "LEAF", ()), (("Xc", "Xa", "Xc"), "LEAF", ())}
    rules = spark.createDataFrame([(1, "m", "Sig_One = 1", "go", ["state Xc"], "Xb", ["Out_Sig"])], "rule_id long, module string, condition string, action string, preconditions array<string>, target_state string, action_signals array<string>")
    found = reasoning.forward_chain(reasoning.impact_edges(moves, rules), spark.createDataFrame([("Xa", "state")], "seed string, seed_type string"), 3)
    assert {(r.node_type, r.node, r.depth) for r in found.collect()} >= {("state", "Xc", 1), ("rule", "1", 2), ("signal", "Out_Sig", 3), ("state", "Xb", 3)}


def test_readers_of_trees_sets_and_pictures(spark, tmp_path):
    (tmp_path / "tree.json").write_text('{"nodes": [{"id": "ch_1", "title": "One"}, {"section_id": "sec_1_1", "parent_id": "ch_1", "level": 2}]}')
    got = {r.section_id: (r.level, r.title, r.parent_id) for r in readers.read_sections(spark, str(tmp_path / "tree.json")).collect()}
    assert got == {"ch_1": (1, "One", None), "sec_1_1": (2, "", "ch_1")}
    (tmp_path / "sets" / "first").mkdir(parents=True)
    (tmp_path / "sets" / "first" / "knowledge_graph.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}], "edges": []}')
    assert [(r.name, r.entities, r.relations) for r in readers.data_sets(spark, str(tmp_path / "sets")).collect()] == [("first", 2, 0)]
    uri = "data:image/png;base64," + base64.b64encode(b"pixels").decode()
    items = spark.createDataFrame([(1, 0, uri), (1, 4, uri), (1, 5, "data:image/svg+xml;base64,AAAA"), (2, 0, "x.png"), (2, 1, None)], "doc_id int, idx int, source string")
    (picture,) = readers.pictures(items).collect()
    assert (picture.idx, picture.suffix, bytes(picture.content), len(picture.name)) == (0, "png", b"pixels", 12)
    placed = sinks.image_paths(readers.pictures(items).withColumn("module", F.lit("a b")).withColumn("section", F.lit("1.2")))
    assert placed.first().storage_path.startswith("a_b/1.2/") and placed.first().storage_path.endswith(".png")
