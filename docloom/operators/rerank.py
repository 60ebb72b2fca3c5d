"""Re-ranking by a model's scores: a scorer takes batches of (query, text) pairs where the candidates are, and falls back to overlap where it fails.

Modes: ``cross`` scores pairs, ``bi`` embeds queries and texts. Candidates: query_id, query, text, score, and whatever else; the result adds
semantic_score and scored_by ('cross', 'bi' or 'jaccard'), and score is the blend. Null texts count as empty; a model sees 2000 signs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_of, tokenize
from docloom.operators.search import jaccard, semantic_boost

# Weights of model and retrieval scores, what a model sees of a text, and the instruction before an embedded query.
CROSS, BI, SEEN = (0.6, 0.4), (0.5, 0.5), 2000
INSTRUCTION = "为这个句子生成表示以用于检索相关文章："

Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def cross_scores(model: Scorer, pairs: list[tuple[str, str]]) -> np.ndarray:
    """Scores within 0..1; those above 1 go through the logistic function, missing ones are 0."""
    said = np.zeros(len(pairs))
    got = np.asarray(model(pairs), float)[: len(pairs)]
    said[: len(got)] = got
    return np.clip(np.where(said > 1, 1 / (1 + np.exp(-np.minimum(said, 500))), said), 0, 1)


def bi_scores(model: Embedder, pairs: list[tuple[str, str]]) -> np.ndarray:
    """(cosine + 1) / 2; each distinct query of a batch is embedded once."""
    queries = sorted({q for q, _ in pairs})
    place = {q: k for k, q in enumerate(queries)}
    unit = lambda rows: (m := np.asarray(rows, float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    asked, texts = unit(model([INSTRUCTION + q for q in queries])), unit(model([t for _, t in pairs]))
    return (np.einsum("ij,ij->i", asked[[place[q] for q, _ in pairs]], texts) + 1) / 2


def rerank(candidates: DataFrame, scorer: Scorer | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Candidates with blended scores: by the scorer, where it fails or is none by the embedder, where that fails or is none by word overlap.

    A failure concerns the batch in which it happens; no candidate is lost.
    """
    words = lambda c: F.array_distinct(tokenize(c))
    rest = [c for c in candidates.columns if c not in ("score", "semantic_score", "scored_by")]
    overlap = jaccard(words("query"), words("text"))
    if scorer is None and embedder is None:
        return candidates.select(*rest, overlap.alias("semantic_score"), F.lit("jaccard").alias("scored_by"), semantic_boost(F.col("score"), overlap).alias("score"))
    given = candidates.select(*rest, "score", F.left(text_of("text"), F.lit(SEEN)).alias("seen_"), overlap.alias("overlap_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip((q or "" for q in b.column("query").to_pylist()), b.column("seen_").to_pylist(), strict=True))
            old = b.column("score").to_numpy(zero_copy_only=False)
            found = None
            for name, model, score, (own, kept) in (("cross", scorer, cross_scores, CROSS), ("bi", embedder, bi_scores, BI)):
                if model is not None and found is None and pairs:
                    try:
                        s = score(model, pairs)
                        found = name, s, own * s + kept * old
                    except Exception:  # noqa: BLE001  any failure of a caller's model means the next way
                        continue
            if found is None:
                s = b.column("overlap_").to_numpy(zero_copy_only=False)
                found = "jaccard", s, old * (0.5 + 0.5 * s)
            name, s, new = found
            columns = [b.column(c) for c in rest] + [pa.array(s, pa.float64()), pa.array([name] * len(s), pa.string()), pa.array(new, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "semantic_score", "scored_by", "score"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", semantic_score double, scored_by string, score double")
