"""Queries on scalar text functions, sections, chunks, tables and rules."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import etl, evaluation
from docloom.plans.planner import route
from docloom.plans.registry import Tables, query
from docloom.sources.storage import stored


@query("SELECT doc_id, greatest(1, floor(length(regexp_replace(coalesce(text, ''), '[^\\x{4e00}-\\x{9fff}]', '', 'g')) * 1.5 + length(regexp_replace(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]', '', 'g')) * 0.3)::INT) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.estimate_tokens("text").alias("tokens"))


_TYPES = (("junk", r"[#$%&*]{3}"), ("numeric", r"[0-9]{3}"), ("long_word", r"[a-z]{12}"))


@query("SELECT doc_id, CASE WHEN regexp_matches(s, '[#$%&*]{3}') THEN 'junk' WHEN regexp_matches(s, '[0-9]{3}') THEN 'numeric' WHEN regexp_matches(s, '[a-z]{12}') THEN 'long_word' ELSE 'general_text' END AS chunk_type FROM (SELECT doc_id, source || ' ' || left(coalesce(text, ''), 500) AS s FROM documents)")
def chunk_type_classify(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.classify("source", "text", _TYPES).alias("chunk_type"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{9,}'), regexp_extract_all(coalesce(text, ''), '[0-9]{2,}')), lambda x: length(x) >= 2)))[1:20], ' | ') AS terms FROM documents")
def key_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.key_terms("text", ("[A-Z][a-z]{9,}", "[0-9]{2,}")).alias("terms"))


def _lines(t: Tables) -> DataFrame:
    """Lines of the documents as items: a line of up to 40 signs is a title, its level follows from its length."""
    parts = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text"))
    n = F.length("text")
    return parts.select("doc_id", "idx", F.lit(0).alias("page"), F.when(n <= 40, "title").otherwise("paragraph").alias("type"), (F.pmod(n, F.lit(3)) + 1).alias("level"), "text", F.lit("").alias("html"))


_ITEMS = "items AS (SELECT doc_id, idx - 1 AS idx, l[idx] AS text, CASE WHEN length(l[idx]) <= 40 THEN 'title' ELSE 'paragraph' END AS type, length(l[idx]) % 3 + 1 AS level FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS idx FROM documents))"


@query(f"WITH {_ITEMS} SELECT doc_id, idx, last_value(CASE WHEN type = 'title' THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS section_idx FROM items")
def section_forward_fill(t: Tables) -> DataFrame:
    return etl.place_items(_lines(t)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("section_idx").cast("long").alias("section_idx"))


@query(f"WITH {_ITEMS}, n AS (SELECT doc_id, max(idx) AS m FROM items GROUP BY 1) SELECT doc_id, idx AS start_idx, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) - 1, m) AS end_idx FROM items JOIN n USING (doc_id) WHERE type = 'title'")
def section_ranges_lead(t: Tables) -> DataFrame:
    return etl.sections(_lines(t)).select("doc_id", F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"))


@query(f"WITH {_ITEMS}, s AS (SELECT * FROM items WHERE type = 'title') SELECT c.doc_id, c.idx AS start_idx, max(p.idx) AS parent_idx FROM s c LEFT JOIN s p ON p.doc_id = c.doc_id AND p.idx < c.idx AND p.level < c.level GROUP BY 1, 2")
def section_parents(t: Tables) -> DataFrame:
    return etl.sections(_lines(t)).select("doc_id", F.col("start_idx").cast("long").alias("start_idx"), F.col("parent_idx").cast("long").alias("parent_idx"))


@query(f"WITH RECURSIVE {_ITEMS}, s AS (SELECT * FROM items WHERE type = 'title'), p AS (SELECT c.doc_id, c.idx, c.text, max(p.idx) AS up FROM s c LEFT JOIN s p ON p.doc_id = c.doc_id AND p.idx < c.idx AND p.level < c.level GROUP BY 1, 2, 3), r AS (SELECT doc_id, idx AS start_idx, idx AS at, up, left(text, 60) AS crumb FROM p UNION ALL SELECT r.doc_id, r.start_idx, p.idx, p.up, left(p.text, 60) || ' > ' || r.crumb FROM r JOIN p ON p.doc_id = r.doc_id AND p.idx = r.up) SELECT doc_id, start_idx, crumb AS breadcrumb FROM r WHERE up IS NULL")
def section_breadcrumbs(t: Tables) -> DataFrame:
    return etl.breadcrumbs(etl.sections(_lines(t))).select("doc_id", F.col("start_idx").cast("long").alias("start_idx"), "breadcrumb")


@query(f"WITH {_ITEMS} SELECT doc_id, idx, coalesce(string_agg(CASE WHEN type = 'title' THEN '[' || left(text, 100) || ']' ELSE left(text, 200) END, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context_before, coalesce(string_agg(CASE WHEN type = 'title' THEN '[' || left(text, 100) || ']' ELSE left(text, 200) END, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS context_after FROM items")
def context_window(t: Tables) -> DataFrame:
    return etl.context(_lines(t)).select("doc_id", F.col("idx").cast("long").alias("idx"), "context_before", "context_after")


@query("SELECT doc_id, 'chunk_' || source || '_' || lpad(row_number() OVER (PARTITION BY source ORDER BY doc_id)::VARCHAR, 6, '0') AS chunk_id FROM documents")
def seq_ids_per_module(t: Tables) -> DataFrame:
    """Numbers of at least six digits, never cut. A hot source is numbered range by range of its ids, on counts of the ranges before."""
    ranges = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(t.documents.select("source", "doc_id").repartitionByRange(ranges, "source", "doc_id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id")))
    placed = nth.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return placed.select("doc_id", F.concat(F.lit("chunk_"), "source", F.lit("_"), F.format_string("%06d", F.col("before") + F.col("nth"))).alias("chunk_id"))


@query("WITH d AS (SELECT lang, greatest(1, floor(length(text) * 0.3)::INT) AS token_count FROM documents) SELECT lang, count(*) AS n, round(avg(token_count), 6) AS mean_tokens, median(token_count) AS median_tokens, count(*) FILTER (token_count < 50) AS near_empty, count(*) FILTER (token_count < 200) AS undersized FROM d GROUP BY 1")
def chunk_quality_stats(t: Tables) -> DataFrame:
    d = t.documents.select("lang", "text", fn.estimate_tokens("text").alias("token_count"))
    return etl.chunk_stats(d, ["lang"]).select("lang", "n", F.round("mean_tokens", 6).alias("mean_tokens"), "median_tokens", "near_empty", "undersized")


@query("WITH c AS (SELECT p_partkey, 'x' || p_size || '=' || p_type || ', y' || p_size || '=' || p_brand AS coding FROM part), e AS (SELECT p_partkey, unnest(string_split(coding, ',')) AS x FROM c) SELECT p_partkey, trim(split_part(x, '=', 1)) AS code, trim(split_part(x, '=', 2)) AS meaning FROM e")
def coding_list_explode(t: Tables) -> DataFrame:
    coding = F.concat(F.lit("x"), F.col("p_size").cast("string"), F.lit("="), "p_type", F.lit(", y"), F.col("p_size").cast("string"), F.lit("="), "p_brand")
    return t.part.select("p_partkey", F.explode(fn.coding_list(coding)).alias("e")).select("p_partkey", "e.code", "e.meaning")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 0 END::DOUBLE AS low, CASE p_partkey % 3 WHEN 0 THEN p_size + 7 WHEN 1 THEN 99 ELSE p_size END::DOUBLE AS high FROM part")
def voltage_range_parse(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    k = F.pmod("p_partkey", F.lit(3))
    said = F.when(k == 0, F.concat(size, F.lit("V-"), (F.col("p_size") + 7).cast("string"), F.lit("V"))).when(k == 1, F.concat(F.lit(">"), size, F.lit("V"))).otherwise(F.concat(F.lit("<"), size, F.lit("V")))
    return t.part.select("p_partkey", fn.voltage_range(said).alias("v")).select("p_partkey", "v.low", "v.high")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def group_counts_grouping_sets(t: Tables) -> DataFrame:
    return evaluation.group_counts(t.documents, [["lang"], ["source"], ["lang", "source"], []]).select("lang", "source", "n")


@query("SELECT c_custkey, trim(regexp_replace(left(regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment, '[^\\p{L}\\p{N}_]', '_', 'g'), '_+', '_', 'g'), 50), '^_+|_+$', '', 'g')) AS safe, 'RULE_' || c_mktsegment || '_' || left(c_name, 10) || '_' || left(md5(c_name), 8) AS rule FROM customer")
def safe_and_rule_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.safe_id(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("safe"), fn.rule_id("c_mktsegment", "c_name", "c_name").alias("rule"))


@query("WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CONFIDENCE=0.' || (event_id % 90 + 10) WHEN 1 THEN 'about ' || (event_id % 101) || '% sure' WHEN 2 THEN 'score 7 then ' || (event_id % 2) ELSE 'none' END AS s FROM events) SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN (event_id % 90 + 10) / 100.0 WHEN 1 THEN CASE WHEN event_id % 101 > 1 THEN (event_id % 101) / 100.0 ELSE event_id % 101 END WHEN 2 THEN event_id % 2 ELSE 0.5 END, 6)::DOUBLE AS confidence FROM e")
def confidence_cascade(t: Tables) -> DataFrame:
    e = F.col("event_id")
    n = lambda k, plus=0: (F.pmod(e, F.lit(k)) + plus).cast("string")
    k = F.pmod(e, F.lit(4))
    said = F.when(k == 0, F.concat(F.lit("CONFIDENCE=0."), n(90, 10))).when(k == 1, F.concat(F.lit("about "), n(101), F.lit("% sure"))).when(k == 2, F.concat(F.lit("score 7 then "), n(2))).otherwise("none")
    return t.events.select("event_id", F.round(fn.confidence(said), 6).alias("confidence"))


@query("SELECT conv_id, turn, CASE WHEN contains(q, 'the') AND contains(q, 'and') THEN 'both' WHEN contains(q, 'que') THEN 'que' WHEN contains(q, 'der') THEN 'der' ELSE 'default' END AS route FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations WHERE role = 'user')")
def router_keyword_override(t: Tables) -> DataFrame:
    rules = [("both", ("the", "and")), ("que", ("que",)), ("der", ("der",))]
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.coalesce(route("text", rules), F.lit("default")).alias("route"))


@query("WITH c AS (SELECT user_id AS query_id, event_type AS dimension, count(*) AS n FROM events GROUP BY 1, 2), d(dimension, cap, weight, threshold) AS (VALUES ('view', 4, 0.4, 0.5), ('click', 3, 0.3, 0.3), ('purchase', 2, 0.3, 0.0)), g AS (SELECT q.query_id, d.*, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT query_id FROM c) q CROSS JOIN d LEFT JOIN c ON c.query_id = q.query_id AND c.dimension = d.dimension), s AS (SELECT query_id, sum(least(n * 1.0 / cap, 1.0) * weight) / greatest(sum(weight), 0.01) AS score, sum((least(n * 1.0 / cap, 1.0) < threshold)::INT) AS gaps FROM g GROUP BY 1) SELECT query_id, round(score, 6)::DOUBLE AS score, gaps::BIGINT AS gaps, score >= 0.6 AND gaps = 0 AS sufficient FROM s")
def completeness_score(t: Tables) -> DataFrame:
    counts = t.events.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    dims = t.spark.createDataFrame([("view", 4, 0.4, 0.5), ("click", 3, 0.3, 0.3), ("purchase", 2, 0.3, 0.0)], "dimension string, cap int, weight double, threshold double")
    return evaluation.completeness(counts, dims).select("query_id", F.round("score", 6).alias("score"), "gaps", "sufficient")


_W = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{3,}}'))"


@query(f"WITH s AS (SELECT conv_id AS id, unnest(string_split(coalesce(text, ''), '.')) AS sentence FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id AS id, list_distinct(flatten(list(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')))) AS known FROM conversations WHERE role = 'user' GROUP BY 1), x AS (SELECT s.id, CASE WHEN len({_W.format('sentence')}) > 0 THEN len(list_intersect({_W.format('sentence')}, coalesce(known, []))) * 1.0 / len({_W.format('sentence')}) ELSE 1.0 END AS share FROM s LEFT JOIN e USING (id)) SELECT id, count(*) AS sentences, sum((share < 0.3)::INT)::BIGINT AS unsupported, round(sum((share < 0.3)::INT) * 1.0 / count(*), 6)::DOUBLE AS ratio FROM x GROUP BY 1")
def hallucination_ratio(t: Tables) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    c = t.conversations
    s = c.where("role = 'assistant'").select(F.col("conv_id").alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), r"\.")).alias("sentence")).withColumn("words", words("sentence"))
    e = c.where("role = 'user'").select(F.col("conv_id").alias("id"), F.explode(words("text")).alias("w")).groupBy("id").agg(F.collect_set("w").alias("words"))
    return evaluation.hallucination(s, e).select("id", "sentences", "unsupported", F.round("ratio", 6).alias("ratio"))
