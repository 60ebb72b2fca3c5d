"""Mentions, links, prose rules, machines, conflicts and containment on hand-made rows; hard rows; the engine's graph as a whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import etl, knowledge, machines, matching
from docloom.plans.domain import body_control
from docloom.session import Engine

ITEMS = "doc_id string, idx int, page int, type string, level int, text string, html string"


def items_of(spark, docs):
    """docs: {doc_id: [(type, text)]}; a title's level is the length of its number."""
    rows = []
    for d, lines in docs.items():
        for k, (kind, text) in enumerate(lines):
            number = re.match(r"[\d.]+", text or "")
            rows.append((d, k, 0, kind, number[0].count(".") + 1 if kind == "title" and number else 1, None if kind == "table" else text, text if kind == "table" else ""))
    return spark.createDataFrame(rows, ITEMS)


def graph_of(items):
    placed = knowledge.located(items, etl.sections(items))
    said = knowledge.mentions(placed, body_control())
    links = knowledge.text_links(placed, said, body_control()).unionByName(knowledge.section_links(said))
    return knowledge.entities_of(said, links), knowledge.edges_of(links), said


def test_ends_are_entities(spark):
    """One name in two documents is one entity; sections are each document's own; what nothing mentions is added, typed by its looks."""
    text = [("title", "1 Lamp"), ("paragraph", "Sig_One 依赖于 nap"), ("paragraph", "详见 第 7.1 节")]
    docs = {"a": text, "b": text, "c": [("paragraph", "Sig_One 依赖于 Sig_Two"), ("paragraph", "参见 2 节"), ("paragraph", None), ("list", "")]}
    entities, edges, said = graph_of(items_of(spark, docs))
    found = {r.entity_id: r for r in entities.collect()}
    assert knowledge.dangling(edges, entities).count() == 0 and entities.count() == len(found)
    assert (found["signal_1_Lamp_Sig_One"].doc_id, found["signal_1_Lamp_Sig_One"].idx) == ("a", 1)
    got = {(r.src, r.dst, r.rel) for r in edges.where("rel <> 'belongs_to'").collect()}
    want = {("signal_1_Lamp_Sig_One", "function_1_Lamp_nap", "depends_on"), ("signal__Sig_One", "signal__Sig_Two", "depends_on"), ("section_c_root", "section_c_2", "references")}
    assert got == want | {(f"section_{d}_1", f"section_{d}_7_1", "references") for d in ("a", "b")}
    assert found["function_1_Lamp_nap"].entity_type == "function" and found["section_a_7_1"].name == "Section 7.1"
    empty, none, _ = graph_of(items_of(spark, docs).limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_known_types_win(spark):
    """A name that its item mentions has that type; elsewhere it has the one it looks like."""
    docs = {"a": [("title", "1 x"), ("paragraph", "Driving 依赖于 Standby"), ("paragraph", "Cfg_A 依赖于 KL30")]}
    _, edges, _ = graph_of(items_of(spark, docs))
    assert {(r.src, r.dst) for r in edges.where("rel = 'depends_on'").collect()} == {("signal_1_x_Driving", "signal_1_x_Standby"), ("signal_1_x_Cfg_A", "signal_1_x_KL30")}


def test_properties_of_later_rows_win(spark):
    rows = [("a", 0, "M", "", "signal", 0, "S", "signal_M_S", {"x": "1", "y": "1"}), ("a", 5, "M", "", "signal", 0, "S", "signal_M_S", {"x": "2"}), ("a", 1, "M", "", "signal", 0, "S", "signal_M_S", {})]
    said = spark.createDataFrame(rows, "doc_id string, idx int, module string, section_path string, entity_type string, rank int, name string, entity_id string, properties map<string,string>")
    links = knowledge.section_links(said)
    (got,) = knowledge.entities_of(said, links).collect()
    assert (got.idx, got.properties) == (0, {"x": "2", "y": "1"})


def test_blocks_of_prose(spark):
    """Marks inside sentences, lists to the current field, passed-over paragraphs, notes, the reach of a block, titles that end it."""
    far = [("paragraph", "x")] * 11
    docs = {
        "a": [("title", "2 VMM"), ("title", "2.1 Inactive模式"), ("title", "2.1.1 迁移到driving状态"), ("paragraph", "满足前置条件：A && B"), ("list", "处于inactive状态\n\n KL15 = 1 "), ("paragraph", "passed over"),
              ("paragraph", "其触发条件如下"), ("list", "Door_Sts = 1"), ("paragraph", "如果超时"), ("paragraph", "则执行 X"), ("list", "迁移 now"), ("title", "2.2 y"), ("list", "lost")],
        "b": [("title", "4.2 z"), ("paragraph", "前置条件 &&"), *far, ("list", "too far")],
        "c": [("title", "4.2 z"), ("paragraph", "前置条件 &&"), ("list", "使能 p"), ("paragraph", "执行输出"), ("list", "使能 q")],
        "d": [("title", "no number"), ("paragraph", "前置条件 &&"), ("list", "p"), ("paragraph", "执行输出"), ("list", "turn Off"), ("paragraph", None)],
        "e": [("paragraph", "前置条件"), ("list", "no sign, no block")],
    }
    got = {r.doc_id: r for r in machines.prose_rules(items_of(spark, docs)).collect()}
    assert set(got) == {"a", "c", "d"}
    a = got["a"]
    assert (a.module, a.rule_type, a.target_state, a.source_state) == ("VMM", "transition_guard", "driving", "Inactive")
    assert a.condition == "处于inactive状态 AND KL15 = 1 AND Door_Sts = 1" and a.action == "则执行 X; 迁移 now"
    assert (got["c"].module, got["c"].rule_type) == ("InteriorLight", "activation_rule")
    assert (got["d"].module, got["d"].rule_type, got["d"].condition) == ("Unknown", "deactivation_rule", "p")
    (move,) = machines.rules_to_transitions(machines.prose_rules(items_of(spark, docs))).collect()
    assert (move.src, move.dst, move.guard, move.id) == ("Inactive", "Driving", "KL15 = 1 AND Door_Sts = 1", "trans_Inactive_to_Driving")


RULES = "rule_id string, module string, rule_type string, condition string, action string, target_state string, preconditions array<string>, triggers array<string>, section_path string, confidence double"


def test_machines(spark):
    rows = [
        ("r1", "Wiper", "transition_guard", "", "go", "fast9", ["处于slow2状态", "K"], ["T"], "1", 0.8),
        ("r2", "Wiper", "activation_rule", "", "进入 Off 状态", "", ["while LowSpeed runs", "OFF"], [], "1", 0.8),
        ("r3", "Wiper", "activation_rule", "", "进入 Nowhere 状态", "", ["while LowSpeed runs"], [], "1", 0.8),
        ("r4", "Other", "voltage_range", "", "", "", None, None, "1", 0.8), ("r5", "Unknown", "transition_guard", "", "", "x", ["处于y状态"], [], "", 0.8), ("r6", "休眠", "transition_guard", "", "迁移到唤醒状态", "唤醒", ["处于休眠状态"], None, "", 0.8),
    ]
    states, moves = machines.build_machines(spark.createDataFrame(rows, RULES))
    names = {(r.module, r.name) for r in states.collect()}
    assert names == {*(("Wiper", s) for s in ("Off", "Intermittent", "LowSpeed", "HighSpeed", "Slow2", "Fast9")), ("休眠", "休眠"), ("休眠", "唤醒")}
    got = {(r.module, r.src, r.dst, r.guard, r.priority) for r in moves.where("module <> 'Unknown'").collect()}
    assert got == {("Wiper", "Slow2", "Fast9", "K AND T", 1), ("Wiper", "LowSpeed", "Off", "while LowSpeed runs AND OFF", 0), ("休眠", "休眠", "唤醒", "", 1)}
    assert {(r.kind, r.state) for r in etl.validate_machine(states.where("module = '休眠'"), moves).collect()} >= {("deadlock", "唤醒"), ("unreachable", "休眠")}


def test_conflicts(spark):
    def rule(k, condition, action, target="", kind="signal", pre=(), module="m"):
        return (k, module, kind, condition, action, target, list(pre))

    here = "处于X状态"
    rows = [
        rule(1, "A_b = 1", "go"), rule(2, "a_b = 2 AND qq = 1", "GO"), rule(3, "A_b = 1", "stop", "S"), rule(4, "qq = 1", "halt", "T"), rule(5, "A_b = 1", "go", module="n"), rule(6, None, None),
        rule(7, here, "p", kind="transition_guard", pre=[here]), rule(8, here, "q", kind="transition_guard", pre=[here]),
        rule(9, "夜间模式", "p", kind="transition_guard"), rule(10, "夜间模式", "r", kind="transition_guard"), rule(11, "夜间模式 雨天模式", "p", kind="transition_guard"), rule(12, "夜间模式 雨天模式", "s", "S"), rule(13, "雨天模式", "s", "T"),
    ]
    df = spark.createDataFrame(rows, "rule_id int, module string, rule_type string, condition string, action string, target_state string, preconditions array<string>")
    got = {(r.a, r.b): r.kind for r in machines.rule_conflicts(df).collect()}
    want = {(1, 2): "redundant", (1, 3): "potential_conflict", (2, 3): "potential_conflict", (2, 4): "potential_conflict", (9, 12): "potential_conflict", (10, 12): "potential_conflict", (11, 12): "potential_conflict", (11, 13): "potential_conflict", (12, 13): "redundant"}
    assert got == want
    df = df.withColumn("action", F.concat("action", F.col("rule_id").cast("string")))
    assert {(r.a, r.b) for r in machines.rule_conflicts(df).where("kind = 'action_conflict'").collect()} == {(12, 13)}
    assert machines.rule_conflicts(df.limit(0)).count() == 0


def test_containment(spark):
    """Against all pairs: short and long terms, repeated grams, blanks, nulls and signs beyond ASCII."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abAB 门锁_") for _ in range(n))
    texts = [(k, text(r.randrange(30))) for k in range(200)] + [(900, None), (901, ""), (902, "aaaa"), (902, "aaaa")]
    terms = [(text(r.randrange(5)),) for _ in range(60)] + [(None,), ("",), ("aaaaa",), ("ab",), ("AB",)]
    got = matching.contains_join(spark.createDataFrame(texts, "id int, said string"), "said", spark.createDataFrame(terms, "term string"), "term")
    want = [(k, s, t) for k, s in texts for (t,) in terms if t and s is not None and t.lower() in s.lower()]
    assert sorted(map(tuple, got.select("id", "said", "term").collect())) == sorted(want)


def test_the_engines_graph(spark):
    """Ends are entities after all enrichment, machines come out, and a chunk profits from a neighbour in the graph."""
    table = "<table><tr><td>Signal name</td><td>Signal type</td><td>PIN</td><td>Description</td></tr><tr><td>Lamp_Relay</td><td>Digital</td><td>A2-01</td><td>x</td></tr></table>"
    docs = {
        "a": [("title", "2 VMM"), ("title", "2.1 Inactive模式"), ("title", "2.1.1 迁移到Driving状态"), ("paragraph", "前置条件 &&"), ("list", "处于Inactive状态\nPEPS_Mode = 1"), ("paragraph", "执行输出"), ("list", "Lamp_Relay ON")],
        "b": [("title", "3 Light"), ("paragraph", "Lamp_Relay 依赖于 Fuse_Box. " + "The relay stands behind the cover of the board. " * 20), ("table", table), ("title", "4 Other"), ("paragraph", "Nothing of interest stands here. " * 20)],
        "c": [("title", "3 Light"), ("paragraph", "Fuse_Box holds the spare parts of the board. " * 20)],
    }
    engine = Engine(spark)
    made = engine.analyse(items_of(spark, docs))
    assert knowledge.dangling(made["edges"], made["entities"]).count() == 0
    assert made["entities"].groupBy("entity_id").count().where("count > 1").count() == 0
    rels = {(r.src, r.dst, r.rel): r.weight for r in made["edges"].collect()}
    assert rels[("signal_3_Light_Lamp_Relay", "hardware_pin_3_Light_A2_01", "outputs")] == 0.8
    assert [(r.module, r.src, r.dst, r.guard) for r in made["transitions"].collect()] == [("VMM", "Inactive", "Driving", "PEPS_Mode = 1")]
    assert any(k[2] == "guarded_by" for k in rels) and any(k[2] == "controls" for k in rels)
    engine.load(made["chunks"], made["entities"], made["edges"], rules=made["rules"], transitions=made["transitions"])
    got = engine.search(spark.createDataFrame([(1, "Lamp_Relay board")], "query_id long, query string"), 5).collect()
    near = next(r for r in got if "spare parts" in r.text)
    assert near.entity_hits > 0 and "Lamp_Relay" not in near.text
    out = engine.ask("Driving 状态 死锁")
    assert {k for k, v in out.items() if getattr(v, "status", "ok") != "ok"} == set()
    assert machines.rule_conflicts(made["rules"]).count() == 0


@pytest.mark.parametrize("cut", ["Idle -> Run", "Idle→Run", "Idle", ""])
def test_moves_are_split(spark, cut):
    rows = spark.createDataFrame([("transition", {"source_state": cut, "trigger": "t"}), ("fault_diag", {"source_state": cut})], "table_class string, fields map<string,string>")
    got = {r.table_class: r.fields for r in knowledge.split_moves(rows).collect()}
    assert got["fault_diag"] == {"source_state": cut}
    assert got["transition"] == ({"source_state": "Idle", "target_state": "Run", "transition_text": cut, "trigger": "t"} if len(cut) > 4 else {"source_state": cut, "trigger": "t"})
