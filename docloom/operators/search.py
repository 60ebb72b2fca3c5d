"""Keyword, vector and fused retrieval over sets of queries: every function maps DataFrames to DataFrames, lazily.

Ranks are total orders: by score rounded to nine digits, then id. The query side is small against the corpus; no join
is forced to broadcast, so adaptive execution does so only where the measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokenize

K1, B, RRF_K = 1.5, 0.75, 60
#: Scores that a task holds at a time (16 MB).
SCORES = 1 << 21


def ranked(df: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "doc_id", name: str = "rank") -> DataFrame:
    """The first ``k`` of each query (a window group limit: each partition forwards at most ``k`` rows a query)."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), tie)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def doc_terms(docs: DataFrame, text: Column | str = "text", tokens=tokenize) -> DataFrame:
    """(doc_id, terms, dl): tokens once for each document."""
    t = docs.select("doc_id", tokens(text).alias("terms"))
    return t.withColumn("dl", F.size("terms"))


def term_counts(terms: DataFrame) -> DataFrame:
    """(term, doc_id, c, dl) of ``doc_terms``. A document's terms are sorted and counted in its own row, so no table of all pairs is hashed."""
    whole = terms.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("sorted"), F.first("dl").alias("dl")).where(F.size("sorted") > 0)
    new = lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1))
    runs = whole.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), new))
    count = lambda i, k: F.struct(F.get("sorted", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("sorted")) - i).cast("long").alias("c"))
    return runs.select("doc_id", "dl", F.explode(F.transform("at", count)).alias("t")).select("t.term", "doc_id", "t.c", "dl")


def postings(docs: DataFrame, text: Column | str = "text", tokens=tokenize) -> DataFrame:
    """(term, doc_id, c, dl, tf): the inverted index; tf is the count over the length."""
    return term_counts(doc_terms(docs, text, tokens)).withColumn("tf", F.col("c") / F.col("dl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text: Column | str = "text", tokens=tokenize) -> DataFrame:
    """One row: n_docs, avg_len (1.0 of an empty corpus)."""
    return doc_terms(docs, text, tokens).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_len"))


def bm25_scores(asked: DataFrame, df: DataFrame, index: DataFrame, stats: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, doc_id, score) from asked terms (query_id, term, times), documents a term (term, df), postings (term, doc_id, c, dl) and one
    row n_docs, avg_len. What a term weighs is settled on the small side; postings are joined once, and stay where they are if the asked terms
    have been counted to be ``few``."""
    weigh = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1) * F.col("times")
    weights = asked.join(df, "term").crossJoin(stats).select("query_id", "term", weigh.alias("w"), F.greatest(F.col("avg_len"), F.lit(1.0)).alias("avg"))  # one row of statistics
    tf = F.col("c") / F.col("dl")
    part = F.col("w") * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg")))
    return index.join(F.broadcast(weights) if few else weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25(queries: DataFrame, docs: DataFrame, text: str = "text", tokens=tokenize) -> DataFrame:
    """(query_id, doc_id, score) over documents without an index; a query's repeated terms count as often as they occur.

    Postings are filtered to the queries' terms before they are counted, so the shuffle holds those alone. Documents at rest that are
    searched more than once want an index (``operators.index``), which tokenises them once.
    """
    asked = queries.select("query_id", F.explode(tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = doc_terms(docs, text, tokens)
    stats = terms.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_len"))
    occurrences = terms.select("doc_id", "dl", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    index = occurrences.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"), F.first("dl").alias("dl"))
    return bm25_scores(asked, document_frequency(index), index, stats)


def _top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    rounded = np.round(scores, 9)
    if len(ids) > 4 * k:
        bound = np.partition(rounded, -k)[-k]
        keep = np.flatnonzero(rounded >= bound)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -rounded[keep]))][:k]


def knn(queries: DataFrame, vectors: DataFrame, k: int, max_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, doc_id, score, rank): exact nearest neighbours by dot product over L2-normalised vectors.

    ``queries`` (query_id, vector) is a stated query set: its size is measured. Up to ``max_bytes`` its matrix is broadcast, and each
    Arrow batch of vectors meets it in BLAS products of up to ``SCORES`` scores that keep ``k`` rows a query. A larger set stays distributed: see ``_knn_grid``.
    A null vector, or a zero one, scores 0.
    """
    spark = vectors.sparkSession
    sample = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not sample.n:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    d = max(1, sample.d or 1)
    if sample.n * d * 8 > max_bytes:
        return ranked(_knn_grid(queries, vectors, k, d, -(-sample.n * d * 8 // max_bytes)), k)
    rows = queries.select("query_id", "vector").toPandas()
    return ranked(_knn_slice(rows["query_id"].to_numpy(np.int64), rows["vector"].tolist(), vectors, k, d), k)


def _blocks(rows: DataFrame, d: int, most: int = 4096) -> DataFrame:
    """(n, ids, matrix): normalised vectors in blocks of up to ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                m = _normalised(part.column(1).to_pylist(), d)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(m)], pa.int32()), "ids": pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), "matrix": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    return rows.mapInArrow(run, "n int, ids binary, matrix binary")


def _knn_grid(queries: DataFrame, vectors: DataFrame, k: int, d: int, groups: int, lanes: int = 64) -> DataFrame:
    """(query_id, doc_id, score): query groups by lanes of vector blocks, in one pass. A task holds one group (some ``max_bytes`` of queries) and
    its best ``k`` so far, streams a lane's blocks past it, and emits ``k`` rows a query; nothing passes through the driver."""
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    asked = _blocks(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")), d).withColumn("g", own(groups)).withColumn("lane", copies(lanes)).withColumn("stage", F.lit(0))
    held = _blocks(vectors.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>")), d).withColumn("lane", own(lanes)).withColumn("g", copies(groups)).withColumn("stage", F.lit(1))
    cells = asked.unionByName(held).select((F.col("g") * lanes + F.col("lane")).cast("int").alias("cell"), "stage", "n", "ids", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, group, best = None, [], None, None

        def results() -> Iterator[pa.RecordBatch]:
            if best is not None:
                real = best[0] > -np.inf
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(group[0], real.sum(1))), "doc_id": pa.array(best[1][real]), "score": pa.array(best[0][real])})

        for batch in batches:
            for at in range(batch.num_rows):
                now, stage, n, ids, matrix = (c[at].as_py() for c in batch.columns)
                if now != cell:
                    yield from results()
                    cell, parts, group, best = now, [], None, None
                ids, m = np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(n, d)
                if stage == 0:
                    parts.append((ids, m))
                    continue
                if group is None and parts:
                    group = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    best = np.full((len(group[0]), k), -np.inf), np.zeros((len(group[0]), k), np.int64)
                for first in range(0, len(group[0]) if group else 0, 256):
                    rows = slice(first, first + 256)
                    s = np.concatenate([best[0][rows], np.round(group[1][rows] @ m.T, 12)], axis=1)
                    i = np.concatenate([best[1][rows], np.broadcast_to(ids, (len(s), n))], axis=1)
                    order = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
                    best[0][rows], best[1][rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        yield from results()

    return cells.repartitionById(groups * lanes, F.col("cell")).sortWithinPartitions("cell", "stage").mapInArrow(run, "query_id long, doc_id long, score double")


def _normalised(rows: list, d: int) -> np.ndarray:
    m = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        if r is not None and len(r) == d:
            m[i] = r
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _knn_slice(query_ids: np.ndarray, query_vectors: list, vectors: DataFrame, k: int, d: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, _normalised(query_vectors, d)))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        for b in batches:
            ids, column = b.column(0).to_numpy(), b.column(1)
            if column.null_count == 0 and len(column.flatten()) == len(ids) * d:
                m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            else:
                m = _normalised(column.to_pylist(), d)
            step = max(1, SCORES // max(1, len(ids)))
            for at in range(0, len(qids), step):  # so that scores take the same room however many queries there are
                scores = q[at : at + step] @ m.T
                picks = [_top_rows(s, ids, k) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[at : at + step], [len(p) for p in picks])), pa.array(ids[np.concatenate(picks)]), pa.array(np.concatenate([s[p] for s, p in zip(scores, picks, strict=True)]))], schema=schema)

    return vectors.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "query_id long, doc_id long, score double")


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, n_lists): reciprocal-rank fusion of (query_id, doc_id, rank) lists, a full outer join as a sum."""
    both = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("query_id", "doc_id", "rank"))
    return both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("n_lists"))


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, doc_id, position): first's 1, second's 1, first's 2, ...; a document keeps its earliest place."""
    both = first.select("query_id", "doc_id", (F.col("rank") * 2).alias("k")).unionByName(second.select("query_id", "doc_id", (F.col("rank") * 2 + 1).alias("k")))
    once = both.groupBy("query_id", "doc_id").agg(F.min("k").alias("k"))
    return once.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "doc_id")).alias("position"))


def dense_boost(score: Column, overlap: Column) -> Column:
    """0.7 of the score and 0.3 of the capped overlap, where there is any."""
    return F.when(overlap > 0, 0.7 * score + 0.3 * F.least(0.15 * overlap, F.lit(0.5))).otherwise(score)


def sparse_boost(score: Column, overlap: Column) -> Column:
    return score * (1 + 0.5 * overlap)


def keyword_boost(score: Column, hits: Column) -> Column:
    return F.when(hits >= 2, score * (1 + 0.2 * F.least(hits, F.lit(5)))).otherwise(score)


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def semantic_boost(score: Column, similarity: Column) -> Column:
    """The deterministic re-ranker: score x (0.5 + 0.5 x Jaccard)."""
    return score * (0.5 + 0.5 * similarity)


def head_tail(df: DataFrame, head: int, rescored: Column, by: str = "query_id") -> DataFrame:
    """Only the first ``head`` ranks are scored anew and re-sorted; the others follow in their old order. Column ``position``."""
    scored = df.withColumn("is_tail", (F.col("rank") > head).cast("int")).withColumn("new_score", F.when(F.col("rank") <= head, rescored).otherwise(F.col("score")))
    order = [F.col("is_tail"), F.when(F.col("is_tail") == 0, -F.round("new_score", 9)).otherwise(F.col("rank")), F.col("doc_id")]
    return scored.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def dedup_prefix(df: DataFrame, size: int, by: str | None = None, score: str = "score", tie: str = "doc_id", text: str = "text") -> DataFrame:
    """Of rows whose texts begin alike the best one stays (an aggregate: hot prefixes combine before the shuffle)."""
    keys = ([by] if by else []) + ["prefix"]
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(tie))).alias("r")
    return df.withColumn("prefix", F.left(F.coalesce(text, F.lit("")), F.lit(size))).groupBy(*keys).agg(best).select("r.*")


def diverse(df: DataFrame, kind: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` rows of each kind, then the first ``k``."""
    w = Window.partitionBy("query_id", kind).orderBy(F.round("score", 9).desc(), "doc_id")
    return ranked(df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).drop("nth", "rank"), k)


def char_budget(df: DataFrame, budget: int, width: int = 500, header: int = 20, most: int = 8) -> DataFrame:
    """The first ``most`` rows in rank order as long as their blocks (cut text and header) fit the budget: a prefix, as the sums only grow."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    block = F.least(F.length("text"), F.lit(width)) + header
    nth = F.count(F.lit(1)).over(w)
    return df.withColumn("used", F.sum(block).over(w)).withColumn("nth_", nth).where((F.col("used") <= budget) & (F.col("nth_") <= most)).drop("nth_")


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a model: token counts in ``dim`` slots (by MD5), as a unit vector; zeros without tokens."""
    slots = F.transform(tokens, lambda t: F.conv(F.left(F.md5(t.cast("binary")), F.lit(8)), 16, 10).cast("long") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, text: str = "text", vector: str = "vector", tokens=tokenize, dim: int = 64) -> DataFrame:
    """``df`` with vectors where ``vector`` is null or missing: by a model (texts to vectors, called batch by batch), else ``hashed_embedding``."""
    have = F.col(vector).cast("array<double>") if vector in df.columns else F.lit(None).cast("array<double>")
    rest = [c for c in df.columns if c != vector]
    if model is None:
        return df.select(*rest, F.coalesce(have, hashed_embedding(tokens(text), dim)).alias(vector))
    rows = df.select(*rest, have.alias(vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = b.column(vector).to_pylist(), b.column(text).to_pylist()
            open_ = [k for k, v in enumerate(found) if v is None]
            for k, v in zip(open_, model([texts[k] or "" for k in open_]) if open_ else [], strict=True):
                found[k] = list(map(float, v))
            yield b.set_column(b.schema.get_field_index(vector), vector, pa.array(found, pa.list_(pa.float64())))

    return rows.mapInArrow(run, rows.schema)


def min_score(df: DataFrame, least: float = 0.0) -> DataFrame:
    """Candidates that score ``least`` or more (0 in dense search, 0.1 in hybrid)."""
    return df.where(F.col("score") >= least)
