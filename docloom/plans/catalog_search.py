"""Queries on keyword, vector and fused retrieval. Searches take as queries the rows whose id is divisible by 50, against all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import ascii_words
from docloom.operators import evaluation, index, search
from docloom.plans import retrieval
from docloom.plans.registry import Tables, query

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')"
_BM25 = f"""
q AS (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark WHERE item_id % 50 = 0),
t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents),
l AS (SELECT doc_id, len({_TOK}) AS dl FROM documents),
c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT count(*) AS n, greatest(coalesce(avg(dl), 1.0), 1.0) AS a FROM l),
bm AS (SELECT q.query_id, c.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (c * 1.0 / dl) * 2.5 / (c * 1.0 / dl + 1.5 * (0.25 + 0.75 * dl / a))) AS score
  FROM q JOIN c USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
"""
_KNN = """
kq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
kn AS (SELECT query_id, vec_id AS doc_id, label, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM kq, embeddings),
kt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kn)
"""


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _bm25(t: Tables, k: int) -> DataFrame:
    """From the documents' index at rest, which the first of these queries builds."""
    return search.ranked(index.index_of(t.documents, tokens=ascii_words).search(_queries(t)), k)


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _knn(t: Tables, k: int, vectors: DataFrame | None = None) -> DataFrame:
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.knn(asked, _vectors(t) if vectors is None else vectors, k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bt WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return _bm25(t, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(t: Tables) -> DataFrame:
    return search.bm25(_queries(t), t.documents, tokens=ascii_words).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), l AS (SELECT doc_id, len({_TOK}) AS dl FROM documents) SELECT term, doc_id, count(*) AS c, round(count(*) * 1.0 / any_value(dl), 9) AS tf FROM t JOIN l USING (doc_id) GROUP BY 1, 2")
def term_freq(t: Tables) -> DataFrame:
    return search.postings(t.documents, tokens=ascii_words).select("term", "doc_id", "c", F.round("tf", 9).alias("tf"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY 1")
def doc_freq(t: Tables) -> DataFrame:
    return search.document_frequency(search.postings(t.documents, tokens=ascii_words))


@query(f"SELECT count(*) AS n_docs, round(coalesce(avg(len({_TOK})), 1.0), 6) AS avg_len FROM documents")
def corpus_stats(t: Tables) -> DataFrame:
    return search.corpus_stats(t.documents, tokens=ascii_words).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {_KNN} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM kt WHERE rank <= 10")
def knn_topk(t: Tables) -> DataFrame:
    return _knn(t, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {_KNN}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM kn WHERE label <= 4) SELECT query_id, doc_id, round(score, 5) AS score, r AS rank FROM x WHERE r <= 10")
def knn_filtered(t: Tables) -> DataFrame:
    near = t.embeddings.where("label <= 4").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))  # before the scores, not after
    return _knn(t, 10, near).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def _overlap(df: DataFrame, t: Tables) -> DataFrame:
    """Candidates with how many graph hits they share with their query: here, equality of labels."""
    label = t.embeddings.select("vec_id", "label")
    q = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    d = label.select(F.col("vec_id").alias("doc_id"), "label")
    return df.join(q, "query_id").join(d, "doc_id").withColumn("overlap", (F.col("label") == F.col("query_label")).cast("int") * (1 + F.pmod("doc_id", F.lit(4))))


_OVER = "o AS (SELECT kt.query_id, kt.doc_id, kt.score, kt.rank, CASE WHEN kt.label = e.label THEN 1 + kt.doc_id % 4 ELSE 0 END AS overlap FROM kt JOIN embeddings e ON e.vec_id = kt.query_id WHERE rank <= 20)"


@query(f"WITH {_KNN}, {_OVER}, b AS (SELECT query_id, doc_id, CASE WHEN overlap > 0 THEN 0.7 * score + 0.3 * least(0.15 * overlap, 0.5) ELSE score END AS s FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM b) SELECT query_id, doc_id, round(s, 5) AS score, rank FROM r WHERE rank <= 10")
def knn_hybrid_boost(t: Tables) -> DataFrame:
    pool = _overlap(_knn(t, 20), t).withColumn("score", search.dense_boost(F.col("score"), F.col("overlap"))).drop("rank")
    return search.ranked(pool, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {_KNN}, {_OVER}, b AS (SELECT query_id, doc_id, score * (1 + 0.5 * overlap) AS s FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM b) SELECT query_id, doc_id, round(s, 5) AS score, rank FROM r WHERE rank <= 10")
def sparse_hybrid_boost(t: Tables) -> DataFrame:
    pool = _overlap(_knn(t, 20), t).withColumn("score", search.sparse_boost(F.col("score"), F.col("overlap"))).drop("rank")
    return search.ranked(pool, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


#: Two rankings of documents for the fusion operators: by size and by a hash-like order, for ten queries each.
_LISTS = """
docs AS (SELECT doc_id, n_chars, source FROM documents),
a AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM docs),
b AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919) % 1009 DESC, doc_id) AS rank FROM docs),
a20 AS (SELECT * FROM a WHERE rank <= 20), b20 AS (SELECT * FROM b WHERE rank <= 20)
"""


def _lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    first = search.ranked(d, 20)
    second = search.ranked(d.withColumn("score", F.pmod(F.col("doc_id") * 7919, F.lit(1009)).cast("double")), 20)
    return first, second


@query(f"WITH {_LISTS}, u AS (SELECT * FROM a20 UNION ALL SELECT * FROM b20), s AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, count(*) AS n_lists FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 9) AS score, n_lists, rank FROM r WHERE rank <= 20")
def rrf_fusion(t: Tables) -> DataFrame:
    return search.ranked(search.rrf(list(_lists(t))), 20).select("query_id", "doc_id", F.round("score", 9).alias("score"), "n_lists", "rank")


@query(f"WITH {_LISTS}, u AS (SELECT query_id, doc_id, rank * 2 AS k FROM a20 UNION ALL SELECT query_id, doc_id, rank * 2 + 1 FROM b20), m AS (SELECT query_id, doc_id, min(k) AS k FROM u GROUP BY 1, 2) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k, doc_id) AS position FROM m")
def interleave_fusion(t: Tables) -> DataFrame:
    return search.interleave(*_lists(t))


_WORDS_SQL = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]{{2,}}'))"
_QWORDS, _DWORDS = _WORDS_SQL.format("b.text"), _WORDS_SQL.format("d.text")


def _with_words(t: Tables, k: int) -> DataFrame:
    q = _queries(t).select("query_id", F.array_distinct(ascii_words("text")).alias("query_words"))
    found = _bm25(t, k).join(q, "query_id").join(t.documents.select("doc_id", "text"), "doc_id")
    return found.withColumn("words", F.array_distinct(ascii_words("text")))  # of what was found alone


_JACCARD = f"j AS (SELECT query_id, doc_id, score, rank, len(list_intersect({_QWORDS}, {_DWORDS})) * 1.0 / greatest(len(list_distinct(list_concat({_QWORDS}, {_DWORDS}))), 1) AS sim FROM bt JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 20)"


@query(f"WITH {_BM25}, {_JACCARD}, js AS (SELECT query_id, doc_id, score * (0.5 + 0.5 * sim) AS score FROM j) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM js")
def jaccard_rerank(t: Tables) -> DataFrame:
    pool = _with_words(t, 20)
    scored = pool.withColumn("score", search.semantic_boost(F.col("score"), search.jaccard(F.col("query_words"), F.col("words"))))
    return search.ranked(scored.drop("rank"), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25}, {_JACCARD}, h AS (SELECT *, CASE WHEN rank <= 12 THEN score * (0.5 + 0.5 * sim) ELSE score END AS s FROM j) SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY (rank > 12)::INT, CASE WHEN rank <= 12 THEN -round(s, 9) ELSE rank END, doc_id) AS position FROM h")
def head_tail_rerank(t: Tables) -> DataFrame:
    sim = search.jaccard(F.col("query_words"), F.col("words"))
    out = search.head_tail(_with_words(t, 20), 12, search.semantic_boost(F.col("score"), sim))
    return out.select("query_id", "doc_id", F.round("new_score", 6).alias("score"), "position")


def _candidates(t: Tables) -> DataFrame:
    """Candidates with the properties the boosts read, derived from the documents' columns."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    kind = F.when(F.col("lang") == "en", "signal_table").when(F.col("lang") == "de", "function_requirement").when(F.col("lang") == "fr", "state_transition").when(F.col("n_chars") % 2 == 0, "division_table").otherwise("general_text")
    j = _bm25(t, 20).join(d, "doc_id").withColumn("chunk_type", kind)
    flag = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    hits = lambda k: F.pmod(F.col("n_chars"), F.lit(k)).cast("int")
    flags = {"in_module": 2, "hint_signal_def": 3, "in_section": 5, "has_table": 7, "has_image": 11, "hint_transition": 13, "hint_division": 17, "hint_tooling": 19}
    counts = {"entity_hits": 4, "keyword_hits": 8, "signal_hits": 3, "state_hits": 2}
    return j.select("query_id", "doc_id", "score", "chunk_type", *(flag(k).alias(c) for c, k in flags.items()), *(hits(k).alias(c) for c, k in counts.items()))


_CAND = """c0 AS (SELECT bt.query_id, bt.doc_id, bt.score, CASE WHEN lang = 'en' THEN 'signal_table' WHEN lang = 'de' THEN 'function_requirement' WHEN lang = 'fr' THEN 'state_transition' WHEN n_chars % 2 = 0 THEN 'division_table' ELSE 'general_text' END AS ct,
doc_id % 2 = 0 AS sm, doc_id % 3 = 0 AS hs, doc_id % 5 = 0 AS ss, doc_id % 7 = 0 AS ht, doc_id % 11 = 0 AS hi, doc_id % 13 = 0 AS hm, doc_id % 17 = 0 AS hd, doc_id % 19 = 0 AS hg,
n_chars % 4 AS eh, n_chars % 8 AS kh, n_chars % 3 AS sh, n_chars % 2 AS th FROM bt JOIN documents USING (doc_id) WHERE rank <= 20)"""


@query(f"""WITH {_BM25}, {_CAND} SELECT query_id, doc_id, round(score * (1 + 0.3 * eh) * CASE WHEN sm AND hs AND ct = 'signal_table' THEN 2.5 WHEN sm THEN 1.6 ELSE 1.0 END
* CASE WHEN hs AND ct = 'signal_table' THEN 1.35 WHEN hs AND ct = 'general_text' AND NOT sm THEN 0.85 ELSE 1.0 END * CASE WHEN hm AND ct = 'state_transition' THEN 1.3 ELSE 1.0 END
* CASE ct WHEN 'function_requirement' THEN CASE WHEN hg OR hd THEN 1.8 ELSE 1.4 END WHEN 'division_table' THEN CASE WHEN hd THEN 2.0 ELSE 1.5 END ELSE 1.0 END
* CASE WHEN kh >= 3 THEN 1 + 0.15 * least(kh, 6) ELSE 1.0 END * CASE WHEN ss THEN 1.2 ELSE 1.0 END, 6) AS score FROM c0""")
def merge_boost(t: Tables) -> DataFrame:
    c = _candidates(t)
    return c.select("query_id", "doc_id", F.round(F.col("score") * retrieval.merge_factor(), 6).alias("score"))


@query(f"""WITH {_BM25}, {_CAND}, b AS (SELECT *, CASE WHEN sm THEN 0.2 ELSE 0 END + CASE WHEN ht THEN 0.1 ELSE 0 END + CASE WHEN hi THEN 0.05 ELSE 0 END + 0.15 * sh + 0.15 * th + CASE WHEN hs AND ct = 'signal_table' THEN 0.2 ELSE 0 END
+ CASE WHEN hm AND ct = 'state_transition' THEN 0.2 ELSE 0 END + CASE ct WHEN 'function_requirement' THEN 0.2 WHEN 'division_table' THEN 0.25 ELSE 0 END + CASE WHEN kh >= 4 THEN 0.1 * least(kh - 3, 5) ELSE 0 END AS rb FROM c0)
SELECT query_id, doc_id, round(rb, 6)::DOUBLE AS rule_score, round(score * (1 + rb), 6)::DOUBLE AS score FROM b""")
def rule_rerank(t: Tables) -> DataFrame:
    c = _candidates(t).withColumn("bonus", retrieval.rule_bonus())
    return c.select("query_id", "doc_id", F.round("bonus", 6).alias("rule_score"), F.round(F.col("score") * (1 + F.col("bonus")), 6).alias("score"))


@query(f"WITH {_KNN} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM kt WHERE rank <= 10 AND score >= 0.3")
def knn_min_score(t: Tables) -> DataFrame:
    return search.min_score(_knn(t, 10), 0.3).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("SELECT doc_id, left(text, 100) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY left(coalesce(text, ''), 100) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_prefix(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.left("text", F.lit(100)).alias("text"), F.col("n_chars").alias("score"))
    return search.dedup_prefix(d, 100).select("doc_id", F.col("text").alias("prefix"))


@query(f"WITH {_BM25}, k AS (SELECT bt.*, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 9) DESC, doc_id) AS nth FROM bt JOIN documents USING (doc_id) WHERE rank <= 50), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r2 FROM k WHERE nth <= 3) SELECT query_id, doc_id, lang, r2 AS rank FROM r WHERE r2 <= 8")
def diversity_topk(t: Tables) -> DataFrame:
    pool = _bm25(t, 50).join(t.documents.select("doc_id", "lang"), "doc_id")
    return search.diverse(pool, "lang", 3, 8).select("query_id", "doc_id", "lang", "rank")


@query(f"WITH {_BM25}, u AS (SELECT query_id, doc_id, rank, sum(least(length(text), 500) + 20) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM bt JOIN documents USING (doc_id) WHERE rank <= 20) SELECT query_id, doc_id, rank, used::BIGINT AS used FROM u WHERE used <= 4000 AND rank <= 8")
def evidence_char_budget(t: Tables) -> DataFrame:
    pool = _bm25(t, 20).join(t.documents.select("doc_id", "text"), "doc_id")
    return search.char_budget(pool, 4000).select("query_id", "doc_id", "rank", F.col("used").cast("long").alias("used"))


@query(f"WITH {_KNN}, x AS (SELECT kt.query_id, kt.rank, kt.label = e.label AS relevant, e.label AS kind FROM kt JOIN embeddings e ON e.vec_id = kt.query_id WHERE rank BETWEEN 2 AND 11), b AS (SELECT query_id, kind, min(CASE WHEN relevant THEN rank - 1 END) AS f FROM x GROUP BY 1, 2) SELECT kind, count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(coalesce(1.0 / f, 0.0)), 6) AS mrr FROM b GROUP BY ROLLUP (kind)")
def ir_metrics_hit_mrr(t: Tables) -> DataFrame:
    label = t.embeddings.select("vec_id", "label")
    found = _knn(t, 11).where("rank > 1").withColumn("rank", F.col("rank") - 1)  # the first neighbour is the query itself
    joined = found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("kind")), "query_id").join(label.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    m = evaluation.ir_metrics(joined.withColumn("relevant", F.col("label") == F.col("kind")), "kind")
    return m.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")])
