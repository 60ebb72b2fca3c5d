"""The keyword index, scorer slot, large query sets and steps that are done once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import index, rerank, search
from docloom.sources import storage

DOCS = [(1, "door lock door"), (2, "window lifts up"), (3, "door window"), (4, None), (5, ""), (6, "门锁 door")]


def scores(df):
    return {(r.query_id, r.doc_id): pytest.approx(r.score) for r in df.collect()}


def test_index_equals_the_scan(spark, tmp_path):
    """Built at once or by segments, with terms that no document has; an unfinished segment isn't there."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "door door lock"), (2, "nothing"), (3, "门锁 window"), (4, None)], "query_id long, text string")
    want = scores(search.bm25(queries, docs))
    whole = index.build_index(docs, f"file://{tmp_path}/a", buckets=3)
    assert scores(whole.search(queries)) == want and len(want) == 6
    parts = index.build_index(docs.where("doc_id < 3"), f"file://{tmp_path}/b")
    assert len(scores(parts.search(queries))) < len(want)
    parts.append(docs.where("doc_id >= 3"))
    assert scores(parts.search(queries)) == want
    lost = spark.createDataFrame([("door", 99, 1, 1, "half", 0)], "term string, doc_id long, c long, dl int, segment string, bucket int")
    lost.withColumn("bucket", parts.bucket("term")).write.mode("append").partitionBy("segment", "bucket").parquet(f"{parts.path}/postings")
    assert scores(parts.search(queries)) == want
    assert index.build_index(docs.limit(0), f"file://{tmp_path}/c").search(queries).count() == 0
    plan = parts.search(queries)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1]


def test_index_of_files_is_found_again(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(path)
    one, two = (index.index_of(spark.read.parquet(path)) for _ in range(2))
    assert one.path == two.path and spark.read.parquet(f"{one.path}/segments").count() == 1
    spark.createDataFrame([(7, "door")], "doc_id long, text string").write.mode("append").parquet(path)
    assert index.index_of(spark.read.parquet(path)).path != one.path


def test_large_query_sets(spark):
    """The grid gives what the broadcast gives: ties, nulls and zero vectors included."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=5), 1)]) for k in range(300)] + [(k, [1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(300, 340)] + [(400, None), (401, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(3)
    queries = vectors.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    plain = {(r.query_id, r.rank): (r.doc_id, round(r.score, 6)) for r in search.knn(queries, vectors, 7).collect()}
    grid = {(r.query_id, r.rank): (r.doc_id, round(r.score, 6)) for r in search.knn(queries, vectors, 7, max_bytes=1000).collect()}
    assert grid == plain and len(plain) == 7 * queries.count()


def test_scorers(spark):
    c = spark.createDataFrame([(1, "door lock", "door lock", 1.0, "x"), (1, "door lock", None, 0.5, "y"), (2, None, "bad text", 0.5, "z")], "query_id long, query string, text string, score double, tag string").coalesce(1)
    by = lambda df: {r.tag: (round(r.semantic_score, 6), r.scored_by, round(r.score, 6)) for r in df.collect()}
    assert by(rerank.rerank(c)) == {"x": (1.0, "jaccard", 1.0), "y": (0.0, "jaccard", 0.25), "z": (0.0, "jaccard", 0.25)}
    got = by(rerank.rerank(c, scorer=lambda pairs: [0.5, 2.0]))
    assert got == {"x": (0.5, "cross", 0.7), "y": (round(1 / (1 + np.exp(-2)), 6), "cross", round(0.6 / (1 + np.exp(-2)) + 0.2, 6)), "z": (0.0, "cross", 0.2)}
    broken = lambda pairs: 1 / 0
    embed = lambda texts: [[1.0, 0.0] if "door" in t else [0.0, 1.0] for t in texts]
    assert by(rerank.rerank(c, broken, embed)) == {"x": (1.0, "bi", 1.0), "y": (0.5, "bi", 0.5), "z": (1.0, "bi", 0.75)}
    assert by(rerank.rerank(c, broken, broken)) == by(rerank.rerank(c))
    assert rerank.rerank(c.limit(0), broken).count() == 0


def test_steps_are_done_once(spark, tmp_path):
    path, made = f"{tmp_path}/in", []

    def make(df):
        made.append(1)
        return df.withColumn("y", F.col("x") + 1)

    spark.range(3).select(F.col("id").alias("x")).write.parquet(path)
    for limit in (1, 1, 2):
        df = spark.read.parquet(path)
        assert storage.step("add", df, lambda df=df: make(df), limit).count() == 3
    assert len(made) == 2
    spark.range(3, 5).select(F.col("id").alias("x")).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    assert storage.step("add", df, lambda: make(df), 1).count() == 5 and len(made) == 3
    table = storage.stored(df)
    storage.discard(table, df)
    assert not storage.exists(spark, table._stored_at) and df.count() == 5


def test_seeds_and_scorers_in_retrieval(spark):
    """Seeds by kind and term, the fallback to keywords, routing by a signal's module, a scorer that turns the order round, vectors made once."""
    from docloom.plans import retrieval
    from docloom.plans.domain import body_control
    from docloom.session import Engine

    entities = spark.createDataFrame(
        [("s1", "signal", "Lamp_Sts", "L", ""), ("f1", "function", "Lamp_Stsx", "W", ""), ("x1", "state", "车窗", "W", ""), ("d1", "fault", "Lamp_Sts", "L", ""), ("c1", "can_message", "Zeta_Id", "L", "")],
        "entity_id string, entity_type string, name string, module string, section_path string",
    )
    edges = spark.createDataFrame([("s1", "c1", "outputs", 0)], "src string, dst string, rel string, ord long")
    asked = spark.createDataFrame([(1, "what is Lamp_Sts 车窗"), (2, "Zeta_Id"), (3, "nothing")], "query_id long, query string")
    intent, named = retrieval.intents(asked, body_control()), retrieval.named_entities(asked, entities)
    seeds = {(r.query_id, r.seed) for r in retrieval.graph_seeds(intent, named, entities).collect()}
    assert seeds == {(1, "s1"), (1, "f1"), (1, "x1"), (2, "c1")}
    assert {(r.query_id, r.seed) for r in retrieval.graph_seeds(intent, named, entities, most=1).collect()} == {(1, "s1"), (2, "c1")}
    chunks = spark.createDataFrame([(f"k{n}", f"lamp text number {n} " + "Lamp_Sts " * n, "L" if n == 2 else "", "general_text", "", "", [], [], [], False) for n in range(1, 4)], "chunk_id string, text string, module string, chunk_type string, section_path string, section_title string, entities array<string>, signals array<string>, states array<string>, has_table boolean")
    engine, calls = Engine(spark), spark.sparkContext.accumulator(0)

    def vector(texts):
        calls.add(len(texts))
        return [[1.0, float("number 3" in t)] for t in texts]

    engine.load(chunks, entities, edges, points=spark.createDataFrame([("k1", [0.0, 1.0])], "chunk_id string, vector array<double>"), embedder=vector)
    assert calls.value == 2 and engine.corpus.points.count() == 3
    lamp = asked.where("query_id = 1")
    got = [r.chunk_id for r in engine.search(lamp).orderBy("rank").collect()]
    assert set(got) == {"k1", "k2", "k3"} and calls.value > 2
    best = engine.search(lamp, scorer=lambda pairs: [1.0 if "number 3" in t else 0.0 for _, t in pairs], rewrite="keywords").orderBy("rank").collect()
    assert best[0].chunk_id == "k3"
