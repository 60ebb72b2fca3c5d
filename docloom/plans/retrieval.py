"""The retrieval pipeline as one lazy plan for a set of queries: intent, graph, sections, BM25 and vectors, fusion, boosts, re-ranking, evidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import CJK, expand_query, rewrite_query, text_of, tokenize
from docloom.operators import graph, reasoning, search
from docloom.operators.index import KeywordIndex
from docloom.operators.matching import contains_join
from docloom.operators.rerank import Embedder, Scorer, rerank
from docloom.plans.domain import Domain
from docloom.sources.storage import stored

#: Candidates that are scored anew.
HEAD = 12


def intents(queries: DataFrame, domain: Domain) -> DataFrame:
    """(query_id, query, question_type, modules, keywords, hints): diagnostic comes before reasoning, reasoning before factual."""
    q = text_of("query")
    low = F.lower(q)
    kind = F.when(low.rlike("故障|诊断|失效|错误|dtc|fault|error"), "diagnostic").when(low.rlike("如何|怎么|为什么|how|why|流程|过程"), "reasoning").otherwise("factual")
    modules = F.array_distinct(F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), v) for k, v in domain.module_aliases.items()], F.lit(None).cast("string")), lambda x: x.isNotNull()))
    phrases = F.slice(F.regexp_extract_all(q, F.lit(f"{CJK}{{2,8}}"), F.lit(0)), 1, 10)
    names = F.slice(F.regexp_extract_all(q, F.lit("[A-Z][A-Za-z0-9_]+"), F.lit(0)), 1, 5)
    hints = [q.rlike(domain.hints[h]).alias(h) if h in domain.hints else F.lit(False).alias(h) for h in ("hint_signal_def", "hint_transition", "hint_division", "hint_tooling")]
    return queries.select("query_id", "query", kind.alias("question_type"), modules.alias("modules"), F.slice(F.concat(phrases, names, modules), 1, 15).alias("keywords"), *hints)


#: What a question may name in the graph; the first four seed the graph's stage, in this order.
NAMED_TYPES = ("signal", "function", "state", "module", "fault", "parameter")
SEED_TYPES = NAMED_TYPES[:4]


def search_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, nth): the query itself, its identifiers and its CJK phrases, the longest first; terms of two signs and more, each once."""
    q = text_of("query")
    longest = lambda found, n: F.slice(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), 1, n)
    names = longest(F.regexp_extract_all(q, F.lit("[A-Z][A-Za-z0-9_]+"), F.lit(0)), 5)
    phrases = longest(F.regexp_extract_all(q, F.lit(f"{CJK}{{2,8}}"), F.lit(0)), 8)
    terms = F.filter(F.array_distinct(F.concat(F.array(q), names, phrases)), lambda x: F.length(x) >= 2)
    return queries.select("query_id", F.posexplode(terms).alias("nth", "term"))


def named_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, nth, tier, entity_id, entity_type, name, module): what a question's terms name, three exact and five partial hits a type and term."""
    terms = search_terms(queries)
    found = reasoning.capped_entities(terms.select("query_id", "term"), entities.where(F.col("entity_type").isin(*NAMED_TYPES)))
    return found.join(terms, ["query_id", "term"]).join(entities.select("entity_id", "name", "module"), "entity_id").drop("term")


def graph_seeds(intent: DataFrame, named: DataFrame, entities: DataFrame, most: int = 10, each: int = 3) -> DataFrame:
    """(query_id, seed): the first ``most`` named entities, by kind, then term; where there is none, up to ``each`` entities a keyword names."""
    kind = F.array_position(F.array(*map(F.lit, SEED_TYPES)), F.col("entity_type"))
    order = F.struct(kind, "nth", "tier", F.length("name"), "entity_id")  # 'exact' comes before 'partial'
    best = named.where(kind > 0).groupBy("query_id", F.col("entity_id").alias("seed")).agg(F.min(order).alias("k"))
    terms = intent.select("query_id", F.posexplode("keywords").alias("nth", "term")).join(best.select("query_id").distinct(), "query_id", "left_anti")
    hits = contains_join(entities.select("entity_id", "name"), "name", terms, "term")
    nth = F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.lower("name") != F.lower("term"), F.length("name"), "entity_id"))
    lost = hits.withColumn("at", nth).where(F.col("at") <= each)
    fallback = lost.groupBy("query_id", F.col("entity_id").alias("seed")).agg(F.min(F.struct(F.lit(0).alias("a"), "nth", F.lit("").alias("b"), F.col("at").alias("c"), "entity_id")).alias("k"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("k"))
    picked = best.withColumn("at", rank).unionByName(fallback.withColumn("at", rank).drop("k"), allowMissingColumns=True)
    return picked.where(F.col("at") <= most).select("query_id", "seed")


def graph_hits(seeds: DataFrame, entities: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, node, distance, rel, name, entity_type, module, section_path): seeds (query_id, seed) and their neighbours."""
    near = graph.expand(graph.collapse(edges), seeds.select("seed").distinct(), hops)
    all_ = seeds.select("query_id", F.col("seed").alias("node"), F.lit(0).alias("distance"), F.lit("self").alias("rel")).unionByName(seeds.join(near, "seed").select("query_id", "node", "distance", "rel"))
    best = all_.groupBy("query_id", "node").agg(F.min_by("rel", "distance").alias("rel"), F.min("distance").alias("distance"))
    return best.join(entities.select(F.col("entity_id").alias("node"), "name", "entity_type", "module", "section_path"), "node", "left")


def hit_sections(hits: DataFrame) -> DataFrame:
    """(query_id, section): the hits' sections and all sections above them."""
    parts = F.split("section_path", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return hits.where("section_path <> ''").select("query_id", F.explode(up).alias("section")).distinct()


def merge_factor() -> Column:
    """The merge stage's factors, one product: entities, owner module, chunk type and hints, keywords, section."""
    f = F.col
    parts = [
        1 + 0.3 * f("entity_hits"),
        F.when(f("in_module"), F.when(f("hint_signal_def") & (f("chunk_type") == "signal_table"), 2.5).otherwise(1.6)).otherwise(1.0),
        F.when(f("hint_signal_def") & (f("chunk_type") == "signal_table"), 1.35).otherwise(1.0),
        F.when(f("hint_signal_def") & (f("chunk_type") == "general_text") & ~f("in_module"), 0.85).otherwise(1.0),
        F.when(f("hint_transition") & (f("chunk_type") == "state_transition"), 1.3).otherwise(1.0),
        F.when(f("chunk_type") == "function_requirement", F.when(f("hint_tooling") | f("hint_division"), 1.8).otherwise(1.4)).otherwise(1.0),
        F.when(f("chunk_type") == "division_table", F.when(f("hint_division"), 2.0).otherwise(1.5)).otherwise(1.0),
        F.when(f("keyword_hits") >= 3, 1 + 0.15 * F.least(f("keyword_hits"), F.lit(6))).otherwise(1.0),
        F.when(f("in_section"), 1.2).otherwise(1.0),
    ]
    return reduce(lambda a, b: a * b, parts)


def rule_bonus() -> Column:
    """The rule stage's bonuses, one sum: module, table, image, signals, states, hints, chunk type, keywords."""
    f = F.col
    parts = [
        F.when(f("in_module"), 0.2), F.when(f("has_table"), 0.1), F.when(f("has_image"), 0.05), 0.15 * f("signal_hits"), 0.15 * f("state_hits"),
        F.when(f("hint_signal_def") & (f("chunk_type") == "signal_table"), 0.2),
        F.when(f("hint_transition") & f("chunk_type").isin("state_transition", "state_machine"), 0.2),
        F.when(f("chunk_type") == "function_requirement", 0.2), F.when(f("chunk_type") == "division_table", 0.25),
        F.when(f("keyword_hits") >= 4, 0.1 * F.least(f("keyword_hits") - 3, F.lit(5))),
    ]
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0.0)), parts, F.lit(0.0))


@dataclass
class Corpus:
    """chunks: chunk_id, text, module, chunk_type, section_path, section_title, entities, signals, states, has_table.
    points (optional): chunk_id, vector. entities and edges: the knowledge graph. index (optional): of the chunks, by chunk_id."""

    chunks: DataFrame
    entities: DataFrame
    edges: DataFrame
    points: DataFrame | None = None
    index: KeywordIndex | None = None


def retrieve(queries: DataFrame, corpus: Corpus, domain: Domain, top_k: int = 10, vectors: DataFrame | None = None, scorer: Scorer | None = None, embedder: Embedder | None = None, rewrite: str = "") -> DataFrame:
    """(query_id, rank, chunk_id, score, rule_score, ...) for queries (query_id, query); ``vectors`` (query_id, vector) adds dense search.

    A question's named entities seed the graph and route it to the modules of its signals. ``rewrite`` ('keywords', or 'hyde' and
    'query2doc' with a column ``written``) adds those names to what keyword search asks. ``scorer`` and ``embedder`` re-rank the best
    candidates, else word overlap does. Blank queries give no rows.
    """
    asked = queries.where(F.trim(text_of("query")) != "")
    intent = intents(asked, domain)
    # both are small and read several times; without tables of their own each reader would match all names anew
    named = stored(named_entities(asked, corpus.entities))
    hits = stored(graph_hits(graph_seeds(intent, named, corpus.entities), corpus.entities, corpus.edges))
    routed = reasoning.signal_modules(named.where("entity_type = 'signal'").select("query_id", F.col("name").alias("signal")).distinct(), corpus.entities, corpus.edges).withColumnRenamed("modules", "routed")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("entity_type") == kind, F.col("name")))).alias(f"named_{kind}s")
    names = named.groupBy("query_id").agg(of("signal"), of("state"), of("function"), of("module"))
    ids = hits.groupBy("query_id").agg(F.collect_set("node").alias("hit_ids"), F.collect_set("module").alias("hit_modules")).join(routed, "query_id", "left").join(names, "query_id", "left")
    sections = hit_sections(hits).groupBy("query_id").agg(F.collect_set("section").alias("hit_sections"))
    worded = asked
    if rewrite:
        written = F.col("written") if "written" in asked.columns else ""
        said = rewrite_query("query", rewrite, written, F.col("named_modules"), F.col("named_signals"), F.col("named_states"), F.col("named_functions"))
        worded = asked.join(names, "query_id", "left").withColumn("query", said)
    expanded = worded.select("query_id", expand_query("query", domain.expansions).alias("text"))
    docs = corpus.chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    lists = [search.ranked(corpus.index.search(expanded) if corpus.index else search.bm25(expanded, docs, tokens=tokenize), 20)]
    if vectors is not None and corpus.points is not None:
        keys = corpus.points.select("chunk_id", "vector", F.xxhash64("chunk_id").alias("doc_id"))
        lists.append(search.knn(vectors, keys.select("doc_id", "vector"), 20).withColumnRenamed("doc_id", "key").join(keys.select(F.col("doc_id").alias("key"), F.col("chunk_id").alias("doc_id")), "key").drop("key"))
    fused = search.ranked(search.rrf(lists), 20).select("query_id", F.col("doc_id").alias("chunk_id"), "score")
    chunks = corpus.chunks.select("chunk_id", "text", "module", "chunk_type", "section_path", "section_title", "entities", "signals", "states", "has_table")
    if "has_image" not in corpus.chunks.columns:
        chunks = chunks.withColumn("has_image", F.lit(False))
    else:
        chunks = chunks.join(corpus.chunks.select("chunk_id", "has_image"), "chunk_id")
    c = fused.join(chunks, "chunk_id").join(intent.drop("query"), "query_id").join(ids, "query_id", "left").join(sections, "query_id", "left")
    none = F.array().cast("array<string>")
    known = lambda x: F.coalesce(x, none)
    said = F.lower(F.concat_ws(" ", "text", "section_title"))
    targets = F.array_union(F.array_union(known("modules"), known("hit_modules")), known("routed"))
    c = c.withColumns({
        "entity_hits": F.size(F.array_intersect(known("entities"), known("hit_ids"))),
        "in_module": (F.col("module") != "") & F.array_contains(targets, F.col("module")),
        "keyword_hits": F.size(F.filter(known("keywords"), lambda k: (F.length(k) >= 2) & F.contains(said, F.lower(k)))),
        "in_section": F.array_contains(known("hit_sections"), F.col("section_path")),
        "signal_hits": F.size(F.array_intersect(known("signals"), F.array_union(known("named_signals"), known("keywords")))),
        "state_hits": F.size(F.array_intersect(known("states"), F.array_union(known("named_states"), known("keywords")))),
    })
    merged = search.dedup_prefix(c.withColumn("score", F.col("score") * merge_factor()).withColumn("tie", F.xxhash64("chunk_id")), 100, by="query_id", tie="tie")
    pool = search.ranked(merged.join(asked.select("query_id", "query"), "query_id").withColumnRenamed("chunk_id", "doc_id"), 20)
    if scorer is None and embedder is None:
        sim = search.jaccard(F.array_distinct(tokenize("query")), F.array_distinct(tokenize("text")))
        reranked = search.head_tail(pool, HEAD, search.semantic_boost(F.col("score"), sim))
    else:
        head = rerank(pool.where(F.col("rank") <= HEAD).select("query_id", "doc_id", "query", "text", "score"), scorer, embedder)
        told = pool.join(head.select("query_id", "doc_id", F.col("score").alias("told")), ["query_id", "doc_id"], "left")
        reranked = search.head_tail(told, HEAD, F.col("told"))
    bonus = rule_bonus()
    final = reranked.withColumn("rule_score", bonus).withColumn("score", F.col("new_score") * (1 + bonus)).drop("rank")
    return search.ranked(final, top_k).select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score", "rule_score", "module", "chunk_type", "section_path", "section_title", "text", "entity_hits", "keyword_hits", "question_type")


def evidence(results: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, evidence): markdown blocks in rank order within the budget; texts that begin alike (200 signs) appear once."""
    once = search.dedup_prefix(results.withColumn("tie", F.col("rank")), 200, by="query_id", tie="tie")
    kept = search.char_budget(once, budget)
    block = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.coalesce("section_title", F.lit("")), F.lit("\n"), F.left("text", F.lit(500)))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return kept.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("evidence"))
