import pytest
from pyspark.sql import functions as F

from docloom.operators import etl
from docloom.plans.domain import body_control
from docloom.session import Engine
from docloom.sources import readers, sinks

TABLE = "<table><tr><th>Voltage</th><th>Range</th><th>Status</th></tr><tr><td>Normal</td><td>9V-16V</td><td>full</td></tr><tr><td>---</td><td>---</td><td>---</td></tr><tr><td>High</td><td>&gt;18V</td><td>off</td></tr></table>"
PAGE = f"""<html><head><title>x</title></head><body><h1>1 Exterior light</h1><p>Intro text about Driving.</p><h2>1.1 Low beam</h2><p>触发条件: State = Inactive</p><p>PEPS_Mode = 1</p>
<p>执行输出: 迁移到 Driving 状态</p><h3>1.1.1 Deep</h3><ul><li>first</li><li>second</li></ul>{TABLE}<h2>1.2 High beam</h2><p>BCM_LightSts fault</p></body></html>"""


@pytest.fixture(scope="module")
def items(spark):
    pages = spark.createDataFrame([(7, PAGE), (8, None), (9, "")], "page_id long, html string")
    return readers.page_items(pages).cache()


def test_items(items):
    got = [(r.type, r.level, r.text) for r in items.orderBy("idx").collect()]
    assert got[0] == ("title", 1, "1 Exterior light")
    assert [g[0] for g in got].count("table") == 1
    assert ("list", None, "first") in got


def test_sections(items):
    got = {r.number: r for r in etl.sections(items).collect()}
    assert got["1.1"].parent_idx == got["1"].start_idx
    assert got["1.1.1"].parent_idx == got["1.1"].start_idx
    assert got["1.2"].parent_idx == got["1"].start_idx
    assert got["1.1"].section_id == "sec_1_1"
    crumbs = {r.start_idx: r.breadcrumb for r in etl.breadcrumbs(etl.sections(items)).collect()}
    assert crumbs[got["1.1.1"].start_idx] == "1 Exterior light > 1.1 Low beam > 1.1.1 Deep"
    assert {r.first_page for r in etl.page_ranges(etl.sections(items), items).collect()} == {0}


def test_tables(items):
    records = etl.table_records(etl.classify_tables(items.where("type = 'table'"), body_control()), body_control())
    got = {r.fields["voltage"]: r.fields["range"] for r in records.collect()}
    assert got == {"Normal": "9V-16V", "High": ">18V"}
    rules = {(r.rule_type, r.condition) for r in etl.table_rules(records).collect()}
    assert ("voltage_range", "Voltage >= 9.0 AND Voltage <= 16.0") in rules


def test_entities_and_chunks(items):
    domain = body_control()
    found = {(r.entity_type, r.name) for r in etl.text_entities(items, domain).collect()}
    assert {("state", "Driving"), ("can_message", "BCM_LightSts")} <= found
    rel = {(r.rel, r.dst) for r in etl.text_relations(etl.place_items(items), domain).collect()}
    assert ("transition_to", "Driving") in rel
    tree, placed = etl.sections(items), etl.place_items(items)
    entities = etl.locate_entities(etl.text_entities(items, domain), placed, tree)
    assert {(r.name, r.section_path) for r in entities.collect()} >= {("Driving", "1"), ("BCM_LightSts", "1.2")}
    chunks = etl.build_chunks(items, domain, entities).orderBy("chunk_id").collect()
    # small groups join the one before; the table stands alone
    assert [(c.section_path, c.has_table) for c in chunks] == [("1", False), ("1.1.1", True), ("1.2", False)]
    assert chunks[0].text.startswith("# 1 Exterior light\nIntro") and "9V-16V" in chunks[1].text
    assert "Driving" in chunks[0].states and any("PEPS_Mode" in e for e in chunks[0].entities) and chunks[1].entities == []
    assert len({c.chunk_id for c in chunks}) == len(chunks)


ITEM = "doc_id string, idx int, page int, type string, level int, text string, html string"


def test_chunks_before_and_without_titles(spark):
    rows = [("a.csv", 0, 0, "table", None, "", "<table><tr><td>x</td><td>y</td></tr></table>"), ("b.md", 0, 0, "paragraph", None, "preface", ""), ("b.md", 1, 0, "title", 1, "1 Exterior light", ""), ("b.md", 2, 0, "paragraph", None, "body", "")]
    got = {(c.doc_id, c.section_path): c for c in etl.build_chunks(spark.createDataFrame(rows, ITEM), body_control()).collect()}
    assert {k: (c.text, c.module, c.section_title, c.breadcrumb, c.has_table) for k, c in got.items()} == {
        ("a.csv", ""): ("x | y", "", "", "", True),
        ("b.md", ""): ("preface\n# 1 Exterior light\nbody", "", "", "", False),
    }
    # a preface long enough to stand alone
    rows[1] = (*rows[1][:5], "preface " * 80, "")
    rows[3] = (*rows[3][:5], "body " * 80, "")
    got |= {(c.doc_id, c.section_path): c for c in etl.build_chunks(spark.createDataFrame(rows, ITEM), body_control()).collect()}
    assert (got["b.md", ""].text, got["b.md", ""].module) == (("preface " * 80), "")
    assert (got["b.md", "1"].module, got["b.md", "1"].breadcrumb) == ("1_Exterior_light", "1 Exterior light")
    assert got["b.md", "1"].text == "# 1 Exterior light\n" + "body " * 80
    assert all(c.chunk_id and c.embedding_text.endswith(c.text) for c in got.values())


def test_chunk_ids_of_several_documents(spark):
    titles = F.explode(F.sequence(F.lit(0), F.lit(2003))).alias("idx")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string").select("doc_id", titles)
    title = F.col("idx") % 2 == 0
    items = docs.select("doc_id", "idx", F.lit(0).alias("page"), F.when(title, "title").otherwise("paragraph").alias("type"), F.when(title, 1).alias("level"), F.when(title, "Light").otherwise(F.concat(F.repeat(F.lit("some words "), F.lit(20)), F.lit("and the paragraph at place "), F.col("idx").cast("string"))).alias("text"), F.lit("").alias("html"))
    chunks = etl.build_chunks(items, body_control()).select("doc_id", "module", "section_path", "section_title", "chunk_type", "text", "has_table", "chunk_id").cache()
    ids = [c.chunk_id for c in chunks.collect()]
    assert len(ids) == len(set(ids)) == 2004
    assert {"chunk_Light_100:a", "chunk_Light_1000:a", "chunk_Light_1000:b", "chunk_Light_001:b"} <= set(ids)
    for c in etl.optimise_chunks(chunks).collect():
        assert [int(x.rsplit(" ", 1)[1]) for x in c.text.split("\n") if x != "# Light"] == list(range(1, 2004, 2))
        assert c.chunk_id == f"chunk_Light_001:{c.doc_id}"


def test_folds(spark):
    groups = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "b", 10), (1, 2, "c", 400), (1, 3, "d", 50), (1, 4, "e", 20)], "doc_id long, ord int, text string, tokens int")
    assert [(r.text, r.tokens, r.last) for r in etl.merge_small(groups).orderBy("ord").collect()] == [("a\nb", 20, 1), ("c", 400, 2), ("d\ne", 70, 4)]
    tables = groups.withColumn("kind", F.when(F.col("text") == "b", "table").otherwise("text"))
    assert [r.text for r in etl.merge_small(tables).orderBy("ord").collect()] == ["a", "b", "c", "d\ne"]
    long = spark.createDataFrame([(1, "\n\n".join(["x" * 2000] * 6))], "doc_id long, text string")
    assert etl.split_long(long, 1500).count() == 3


def test_pipeline(spark, items):
    engine = Engine(spark)
    made = engine.analyse(items)
    moves = spark.createDataFrame([("Inactive", "Driving", "")], "src string, dst string, guard string")
    engine.load(made["chunks"], made["entities"], made["edges"], rules=made["rules"], transitions=moves)
    queries = spark.createDataFrame([(1, "PEPS_Mode 触发条件"), (2, "   ")], "query_id long, query string")
    got = engine.search(queries, 3).collect()
    assert {r.query_id for r in got} == {1}
    best = min(got, key=lambda r: r.rank)
    assert best.section_path == "1" and best.entity_hits > 0
    out = engine.ask("Driving 状态 死锁")
    assert out["template"] == "reachability_check"
    assert {k for k, v in out.items() if getattr(v, "status", "ok") != "ok"} == set()
    assert spark.createDataFrame([(1, "x")], "query_id long, query string").transform(engine.templates).first().template == "factual_lookup"


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "kg.json").write_text('{"nodes": [{"id": "a", "type": "signal", "name": "A\'s"}], "edges": [{"source": "a", "target": "b", "type": "Controls"}, {"source": "", "target": "b"}]}')
    entities, edges = readers.read_graph(spark, str(tmp_path / "kg.json"))
    assert {r.entity_id for r in entities.collect()} == {"a", "b"}
    assert [(r.src, r.dst, r.rel) for r in edges.collect()] == [("a", "b", "controls")]
    said = [r.statement for r in sinks.cypher(entities, edges).orderBy("part").collect()]
    assert any("A\\'s" in s for s in said)
    sinks.write_cypher(entities, edges, str(tmp_path / "cypher"))
    (tmp_path / "points.json").write_text('{"dim": 3, "points": [{"id": "p", "vector": null}, {"id": "q", "vector": [1, 0, 0]}]}')
    assert {r.id: list(r.vector) for r in readers.read_points(spark, str(tmp_path / "points.json")).collect()} == {"p": [0, 0, 0], "q": [1, 0, 0]}
    for m in ("x", "y"):
        (tmp_path / f"state_machine_{m}.json").write_text('{"module": "%s", "states": [{"name": "S"}], "transitions": [{"source": "S", "target": "T"}]}' % m)
    states, moves = readers.read_state_machines(spark, str(tmp_path / "state_machine_*.json"))
    assert {r.module for r in moves.collect()} == {"x", "y"} and states.count() == 2
    (tmp_path / "empty.json").write_text('{"text_chunks": []}')
    with pytest.raises(Exception, match="no text_chunks"):
        readers.read_chunks(spark, str(tmp_path / "empty.json")).collect()
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# One\n\ntext\n\n|a|b|\n|-|-|\n|1|2|\n- item\n")
    (docs / "b.bin").write_bytes(b"\0")
    got = readers.parse_documents(spark, str(docs)).collect()
    assert [r.type for r in got if r.doc_id.endswith("a.md")] == ["title", "paragraph", "table", "list"]
    assert [r.warnings for r in got if r.doc_id.endswith("b.bin")] == [["no parser for .bin"]]
