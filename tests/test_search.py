import math
from collections import Counter
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import evaluation, search
from docloom.plans import planner
from docloom.plans.domain import Domains, body_control
from docloom.streaming import ingest

DOCS = [(1, "door lock door"), (2, "window lifts up"), (3, "door window"), (4, None), (5, "")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "door door lock"), (2, "nothing")], "query_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(queries, docs).collect()}
    toks = {i: (t or "").split() for i, t in DOCS}
    avg = sum(map(len, toks.values())) / len(toks)
    for i, score in got.items():
        expect = 0
        for term in ("door", "door", "lock"):
            tf = Counter(toks[i])[term] / len(toks[i])
            df = sum(term in x for x in toks.values())
            expect += math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks[i]) / avg))
        assert score == pytest.approx(expect)
    assert set(got) == {1, 3}


def test_knn_ties_nulls_and_prefixes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, vector array<double>")
    got = [(r.doc_id, round(r.score, 6)) for r in search.knn(queries, vectors, 4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    assert [(r.doc_id, round(r.score, 6)) for r in search.knn(queries, vectors, 2).orderBy("rank").collect()] == got[:2]
    assert search.knn(queries.limit(0), vectors, 2).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.permutations([1, 2, 3, 4]))
def test_rrf_does_not_depend_on_order(spark, order):
    a = spark.createDataFrame([(1, d, r + 1) for r, d in enumerate(order)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, d, d) for d in (1, 2)], "query_id long, doc_id long, rank int")
    one, two = ({r.doc_id: round(r.score, 12) for r in search.rrf(x).collect()} for x in ([a, b], [b, a]))
    assert one == two


def test_router():
    assert Domains().list() == ["bcm", "generic"]


def test_templates(spark):
    rows = [("车窗为什么无法启动", "diagnostic"), ("从A到B的路径", "path_finding"), ("影响哪些功能", "impact_analysis"), ("进入Driving需要什么条件", "state_transition"), ("状态机是否死锁", "reachability_check"), ("Driving是什么", "state_transition"), ("PEPS是什么", "factual_lookup"), ("", "factual_lookup"), ("driving now", "state_transition")]
    got = spark.createDataFrame(rows, "query string, want string").select("query", "want", planner.select_template("query", body_control()).alias("got")).collect()
    assert [(r.query, r.got) for r in got] == rows


def test_plan_pieces():
    assert planner.topological_levels(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")]) == [["a"], ["b"], ["c"]]
    assert planner.follow("sm.states[*].name", {"sm": {"states": [{"name": "x"}, {"name": "y"}]}}) == ["x", "y"]
    assert planner.follow("s[-1]", {"s": [1, 2]}) == 2
    assert planner.follow("s.t", {}) is None
    said, spans = planner.resolve_dates("今天距离2025-01-01不足半年", date(2025, 3, 1))
    assert said.startswith("2025-03-01") and spans == {"半年": 180, "2025-01-01": 59}


def test_failed_nodes_are_results(spark):
    plan = planner.build_plan("reachability_check", disabled=("rule_lookup", "state_machine", "chunk_search"))
    assert plan.nodes == ["intent", "reachability", "completeness"]
    ok = lambda p, given: spark.range(1)
    out = planner.run_plan(plan, {"intent": ok, "completeness": ok, "reachability": lambda p, g: 1 / 0})
    assert {k: v.status for k, v in out.items()} == {"intent": "ok", "reachability": "failed", "completeness": "ok"}


def test_metrics(spark):
    r = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (3, 1, True)], "query_id int, rank int, relevant boolean")
    m = evaluation.ir_metrics(r).first()
    assert (m.n, round(m.hit_1, 4), round(m.hit_3, 4), round(m.mrr, 4)) == (3, 0.3333, 0.6667, 0.5)
    s = spark.createDataFrame([(["a", "b"], ["a", "c"], ["X = 1"], ["x", "y"], [["b"]]), ([], ["a"], [], [], [])], "p array<string>, e array<string>, c array<string>, d array<string>, f array<array<string>>")
    assert [round(r.x, 4) for r in s.select(evaluation.path_score(*map(F.col, "pecdf")).alias("x")).collect()] == [0.65, 0.0]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "door lock"), (2, "door")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), docs)
    ingest.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.term, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("door", 1), ("lock", 1), ("door", 2)}
