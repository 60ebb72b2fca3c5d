"""What must not grow with the tables: broadcasts chosen by the size of files, pairs of alike rules, work a question."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import enrich, etl, explain, index, knowledge, machines, search, trees
from docloom.plans import catalog, catalog_knowledge, patterns
from docloom.plans.domain import body_control
from docloom.plans.registry import Tables

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alike_rules_are_one_class(spark):
    """3000 equal rules are one class that conflicts with itself; their pairs are counted without being made, and written whole when asked for."""
    k = F.col("id")
    rules = spark.range(3000).select(k.alias("rule_id"), F.lit("m").alias("module"), F.lit("Sig_Abc = 1").alias("condition"), F.lit("go").alias("action"))
    other = spark.range(5000, 5002).select(k.alias("rule_id"), F.lit("m").alias("module"), F.lit("Sig_Abc = 2").alias("condition"), F.lit("stop").alias("action"))
    classes, _, pairs = machines.conflict_classes(rules.unionByName(other))
    assert classes.count() == 2 and pairs.count() == 3
    got = {r.kind: (r.n, r.signals, r.states) for r in machines.conflict_kinds(rules.unionByName(other)).collect()}
    assert got == {"redundant": (3000 * 2999 // 2 + 1, 3000 * 2999 // 2 + 1, 0), "potential_conflict": (6000, 6000, 0)}
    few = rules.where("rule_id < 700").unionByName(other)
    made = machines.rule_conflicts(few)
    assert made.count() == made.select("a", "b").distinct().count() == 700 * 699 // 2 + 1 + 1400 and made.where("a >= b").count() == 0


def test_targets_stay_with_their_rules(spark):
    """A pair's targets follow its ids, whichever class comes first."""
    rows = [(5, "A"), (1, "B"), (9, "B"), (7, "A")]
    rules = spark.createDataFrame([(i, "m", "Sig_Abc = 1", f"go {t}", t) for i, t in rows], "rule_id int, module string, condition string, action string, target_state string")
    target = dict(rows)
    got = machines.rule_conflicts(rules).where("kind = 'action_conflict'").collect()
    assert {(r.a, r.b) for r in got} == {(1, 5), (1, 7), (5, 9), (7, 9)} and all((r.target_a, r.target_b) == (target[r.a], target[r.b]) for r in got)


@tables
@pytest.mark.parametrize("name", ["body_items", "condition_expressions", "rules_of_prose", "transitions_of_rules"])
def test_documents_are_not_broadcast(spark, name):
    """Files of a few hundred bytes hold as many rows as they like; their joins by document go by a shuffle."""
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, DATA))


@tables
def test_machines_broadcast_vocabularies_alone(spark):
    """Only the given states meet the modules by broadcast; nothing of a document does."""
    said = plan(catalog.QUERIES["machine_states"](spark, DATA))
    assert said.count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in said


@tables
def test_reports_do_not_broadcast_rules(spark):
    """Impacted nodes are as many as the rules; only the names that no rule has are few."""
    said = plan(catalog.QUERIES["impact_reports"](spark, DATA))
    assert said.count("SortMergeJoin") >= 4


def test_equal_questions_are_answered_once(spark, monkeypatch):
    """Rules meet each distinct term once, and the ranking is that of a brute force over all questions."""
    met, join = [], explain.contains_join
    monkeypatch.setattr(explain, "contains_join", lambda rows, text, terms, term: met.append(terms.count()) or join(rows, text, terms, term))
    rules = [(i, f"M{i % 3}", f"Sig_Abc{i % 5} = 1", f"Out{i % 7}") for i in range(60)]
    asked = [(q, t) for q in range(40) for t in (f"sig_abc{q % 5}", f"SIG_ABC{q % 5}", f"out{q % 2}", f"M{q % 3}", "", None)]
    got = explain.matched_rules(spark.createDataFrame(asked, "query_id long, term string"), spark.createDataFrame(rules, "rule_id long, module string, condition string, action string"))
    want = set()
    for q in range(40):
        terms = {t.lower() for k, t in asked if k == q and t}
        hits = sorted((-sum(t in " ".join(map(str, r)).lower() for t in terms), r[0]) for r in rules if any(t in " ".join(map(str, r)).lower() for t in terms))
        want |= {(q, n, i, -m) for n, (m, i) in enumerate(hits[:8], 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert met == [10]


def test_scores_take_the_same_room(spark, monkeypatch):
    """Few scores at a time, the same neighbours; a batch never multiplies all queries at once."""
    rows = [(i, [float((i * 7) % 11 - 5), float(i % 3), 1.0]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>").coalesce(1)
    queries = vectors.select(F.col("doc_id").alias("query_id"), "vector")
    want = {tuple(r) for r in search.knn(queries, vectors, 5).collect()}
    monkeypatch.setattr(search, "SCORES", 1000)
    got = search.knn(queries, vectors, 5)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 1000


def test_a_table_is_parsed_once(spark):
    """A filter on the class of a table does not parse its HTML anew for each keyword."""
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("idx"), F.concat(F.lit("<table><tr><td>Voltage</td><td>Range</td></tr><tr><td>a"), "id", F.lit("</td><td>9V-16V</td></tr></table>")).alias("html"))
    found = etl.classify_tables(rows, body_control()).where("table_class <> 'unknown'")
    assert found.count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("<tr[^>]*>") <= 2


@tables
def test_items_meet_their_sections_by_document(spark):
    """Items are dealt out by document before patterns are looked for: a small file is no single task, its rows no broadcast."""
    items = catalog_knowledge._spoken(Tables(spark, DATA))
    assert plan(knowledge.located(items, etl.sections(items))).count("SortMergeJoin") >= 2


def test_index_tasks_follow_the_text(spark):
    """What a task writes is bounded by the text, not by the number of buckets alone, and no two slots share a task."""
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert index.slices_for(docs, 8) == 1
    built = index.build_index(docs)
    assert built.postings().count() == 30
    for size, most in ((1 << 30, 16 << 20), (6 << 30, 16 << 20)):
        index_bytes, index._bytes = index._bytes, lambda df, n=size: n
        try:
            assert size / (8 * index.slices_for(docs, 8)) <= most
        finally:
            index._bytes = index_bytes


def test_lines_are_written_once(spark):
    """A transition's lines are made before questions meet them; every one of them arrives, equal ones too, and a state holds more than a bundle."""
    moves = [("A", "B" if i % 2 else "A", None if i % 3 else f"g{i % 5}", "M" if i % 7 else "N", i // 2) for i in range(1500)]
    asked = [(q, m, s) for q in range(3) for m in "MN" for s in "AB"] + [(9, "M", "Z"), (9, None, "A")]
    got = explain.machine_lines(spark.createDataFrame(asked, "query_id int, module string, state string"), spark.createDataFrame(moves, "src string, dst string, guard string, module string, ord long"))
    want = []
    for q, m, s in asked:
        for src, dst, guard, module, at in moves:
            for way in [w for w, end in (("from", dst), ("to", src)) if m == module and end == s]:
                want += [(q, f"{m}: {s} {way}", str(at), 0, f"{src} → {dst} []")] + [(q, f"{m}: {s} {way}", str(at), 1, f"Guard: {guard}")] * bool(guard)
    assert sorted(tuple(r) for r in got.drop("part").collect()) == sorted(want)
    said = got._jdf.queryExecution().optimizedPlan().toString()
    assert said.index("Join") < said.index("Guard: ")


def test_alike_rules_meet_intents_as_their_first(spark, monkeypatch):
    """Of rules that hold the same words the first eight meet the intents; the ranking is that of a brute force over all rules."""
    kept, store = [], enrich.stored
    monkeypatch.setattr(enrich, "stored", lambda df: kept.append(store(df)) or kept[-1])
    rules = [(i, f"M{i % 3}" if i % 11 else None, f"Sig_{i % 4}", f"do {i % 2}" if i % 5 else None) for i in range(900)]
    intents = [(q, [f"M{q % 3}", "M1"], ["SIG_1", "sig_1"], [], ["do 1", ""], ["sig"] if q % 2 else None) for q in range(6)] + [(7, [], ["nothing"], None, [], [])]
    got = enrich.rule_relevance(
        spark.createDataFrame(rules, "rule_id long, module string, condition string, action string"),
        spark.createDataFrame(intents, "query_id long, modules array<string>, signals array<string>, states array<string>, functions array<string>, keywords array<string>"),
    )
    want = set()
    for q, modules, signals, states, functions, words in intents:
        asked = [(w.lower(), 2) for w in signals + (states or []) + functions if w] + [(w.lower(), 1) for w in words or [] if w]
        score = {(i, m): 3 * (m in modules) + sum(n for w, n in asked if w in " ".join(x for x in (c, a) if x).lower()) for i, m, c, a in rules}
        best = sorted((-n, i, m) for (i, m), n in score.items() if n)[:8] if any(score.values()) else []
        want |= {(q, i, m, -n, k) for k, (n, i, m) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert kept[0].count() <= 4 * 8 * 8


def test_terms_are_counted_in_their_document(spark):
    """Pairs of term and document are never hashed or sorted; empty and repeated documents count as before."""
    texts = [(1, "one two one"), (2, ""), (3, None), (4, "two"), (4, "two three"), (None, "one")]
    got = search.postings(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {(r.term, r.doc_id, r.c) for r in got.collect()} == {("one", 1, 2), ("two", 1, 1), ("two", 4, 2), ("three", 4, 1), ("one", None, 1)}
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("term", "string"), ("doc_id", "bigint"), ("c", "bigint"), ("dl", "int"), ("tf", "double")]
    assert "keys=[term" not in plan(got) and "key=[term" not in plan(got)


@pytest.mark.parametrize("many", [3, 2000])
def test_classes_are_dealt_by_their_size(spark, many):
    """A small class is one row of ids, a large one as many as it fills; every pair of rules comes once, whatever part its ids are in."""
    k = F.col("id")
    rule = lambda df, action: df.select(k.alias("rule_id"), F.lit("m").alias("module"), F.lit("Sig_Abc = 1").alias("condition"), F.lit(action).alias("action"))
    rules = rule(spark.range(many), "go").unionByName(rule(spark.range(5000, 5040), "stop"))
    _, members, _ = machines.conflict_classes(rules)
    parts = {r["class"]: (r.parts, r.n) for r in members.groupBy("class").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size("ids")).alias("n")).collect()}
    assert parts == {0: (-(-many // machines.BLOCK), many), 5000: (1, 40)}
    made = machines.rule_conflicts(rules)
    assert made.count() == made.select("a", "b").distinct().count() == many * (many - 1) // 2 + 40 * 39 // 2 + 40 * many and made.where("a >= b").count() == 0


def test_pairs_ask_for_tasks(spark, monkeypatch):
    """Pairs are written by as many tasks as the rules ask for, not by those that the small rows before them fill."""
    monkeypatch.setattr(machines, "PAIRS", 1000)
    k = F.col("id")
    rules = spark.range(300).select(k.alias("rule_id"), F.lit("m").alias("module"), F.concat(F.lit("Sig_Abc"), k % 7, F.lit(" = 1")).alias("condition"), F.concat(F.lit("go "), k % 11).alias("action"))
    made = machines.rule_conflicts(rules)
    assert made.count() == sum(300 // 7 + (r < 300 % 7) - 1 and (300 // 7 + (r < 300 % 7)) * (300 // 7 + (r < 300 % 7) - 1) // 2 for r in range(7))
    assert plan(made).count(", 45), REPARTITION_BY_NUM") == 4


@tables
@pytest.mark.parametrize(("name", "times"), [("rules_of_prose", 2), ("transitions_of_rules", 2), ("machine_states", 2)])
def test_documents_are_scanned_once(spark, name, times):
    """Items are made once for the blocks and once, titles alone, for the sections; nothing of a document is made anew for each step."""
    assert plan(catalog.QUERIES[name](spark, DATA)).count("FileScan parquet") == times


def test_overlapping_blocks_look_back(spark):
    """Items belong to every opening within reach; rows without a document or a place open nothing, and sections '2.1' and '2.10' both stand under '2.'."""
    said = [("title", "2.10 Night模式"), ("paragraph", "前置条件 && a"), ("list", "p"), ("paragraph", "前置条件 && b"), ("paragraph", "执行输出"), ("list", "enable q"), ("title", "2.1 迁移到on状态"), ("paragraph", "前置条件 &&"), ("list", "r")]
    rows = [(d, i, kind, text) for d in ("a", None) for i, (kind, text) in enumerate(said)] + [("b", None, "paragraph", "前置条件 &&"), ("b", 1, "list", "lost")]
    got = machines.prose_rules(spark.createDataFrame(rows, "doc_id string, idx int, type string, text string"))
    found = {(r.doc_id, r.block): (tuple(r.preconditions), r.action, r.section_path, r.target_state, r.source_state) for r in got.collect()}
    assert found == {("a", 1): (("p",), "enable q", "2.10", "", "Night"), ("a", 3): ((), "enable q", "2.10", "", "Night"), ("a", 7): (("r",), "ENTER on; ENTER on", "2.1", "on", "Night")}


@tables
@pytest.mark.parametrize("name", ["table_classes", "table_rows", "rules_of_tables"])
def test_tables_are_dealt_out(spark, name):
    """Suppliers in a single split are parsed by as many tasks as there are cores."""
    assert plan(catalog.QUERIES[name](spark, DATA)).count("hashpartitioning(s_suppkey") >= 1


@tables
def test_references_cross_once(spark):
    """What groups hold meets its documents' items in one shuffle by document, not in one a join and level."""
    assert plan(catalog.QUERIES["body_items"](spark, DATA)).count("Exchange hashpartitioning(") == 1


def test_bodies_are_read_as_by_a_walk(spark):
    """Groups anywhere, the root among them, cycles, lost and nameless references: the order is that of a plain walk."""
    draw, nodes, children, want = random.Random(5), [], [], set()
    for d in [*range(60), None]:
        kinds = {f"r{i}": draw.choice(["group", "group", "text", "table", "key_value"]) for i in range(9)} | ({"#/body": "group"} if draw.random() < 0.2 else {})
        below = {p: draw.sample([*kinds, "gone", None], draw.randint(0, 4)) for p in ["#/body", *kinds]}
        nodes += [(d, ref, kind, i) for i, (ref, kind) in enumerate(kinds.items())]
        children += [(d, p, i, ref) for p, refs in below.items() for i, ref in enumerate(refs)]
        said = []

        def walk(p, above):
            for ref in below[p]:
                if kinds.get(ref) == "group" and ref not in above:
                    walk(ref, above | {ref})
                elif kinds.get(ref, "group") != "group" and ref not in said:
                    said.append(ref)

        if d is not None:
            walk("#/body", set())
        lost = [ref for kind in trees.ORPHANS for ref, k in kinds.items() if k == kind and ref not in said]
        want |= {(d, i, ref, kinds[ref], ref in lost) for i, ref in enumerate(said + lost)}
    got = trees.body_order(spark.createDataFrame(nodes, "doc_id long, ref string, kind string, ord int"), spark.createDataFrame(children, "doc_id long, parent string, nth int, ref string"))
    assert {tuple(r) for r in got.collect()} == want


@tables
def test_sections_and_ends_are_not_broadcast(spark):
    """A document's last place, an entity's properties and the entities that edges end in are as many as the documents: all of them are merged."""
    items = catalog_knowledge._spoken(Tables(spark, DATA))
    assert "Broadcast" not in plan(knowledge.located(items, etl.sections(items)))
    entities, edges, _ = catalog_knowledge._graph(Tables(spark, DATA))
    assert "Broadcast" not in plan(entities) and "Broadcast" not in plan(knowledge.dangling(edges, entities))


def test_cues_lose_nothing(spark):
    """A text without a pattern's cues does not hold the pattern; each pattern is found in some text, and most texts are spared most patterns."""
    draw = random.Random(3)
    words = sorted({w for cues in patterns.CUES.values() for w in cues} | {"Armed", "Disarmed", "Charging", "0x1AF", "BCM_Abc", "Sig_A", "Cfg_X", "KL30", "发送", "时", "触发", "激活", "上升沿", "需要", "处于", "配置", "第 2.1 节", "详见", "按照", "的", "输出", "模块", "车窗", "=", "==", "：", ":", ",", "DTC"})
    texts = ["".join(draw.choice(words) + draw.choice(["", " ", " "]) for _ in range(draw.randint(1, 9))) for _ in range(6000)] + [s.replace("{k}", "7") for s in catalog_knowledge._SAID]
    told = F.col("text")
    seen = spark.createDataFrame([(t,) for t in texts], "text string").select(*(F.struct(told.rlike(p).alias("held"), knowledge._may_hold(told, p).alias("may")).alias(f"p{n}") for n, p in enumerate(patterns.CUES)))
    sums = seen.agg(*(F.struct(F.count_if(f"p{n}.held").alias("held"), F.count_if(F.col(f"p{n}.held") & ~F.col(f"p{n}.may")).alias("lost"), F.count_if(f"p{n}.may").alias("may")).alias(f"p{n}") for n in range(len(patterns.CUES)))).first()
    assert all(x.held > 0 and x.lost == 0 and x.may < len(texts) for x in sums)
    assert {p for _, p, *_ in patterns.RELATIONS} <= set(patterns.CUES)
