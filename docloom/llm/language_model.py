"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and uniform maximum-likelihood estimates.

    P(w | u v) = a3(b) * c(u v w) / c(u v)  +  a2(b) * c(v w) / c(v)  +  a1(b) * c(w) / N  +  a0(b) / (V + 1)

The weights depend on the context's frequency bucket b: floor(log2 c(u v)), or floor(log2 c(v)) where u v is unseen. They are
learned by expectation-maximisation on deleted counts: every training token in turn is a held-out event, its own occurrence taken
from all counts (c - 1, N - 1) before the weights must predict it. The final model uses the whole counts with those weights.

Plan (see ``exchange``): documents become chunks of word codes, written once; chunks ask for their distinct words, bigrams and
trigrams and get corpus counts in the chunks' order; a cogroup of chunks and answers stores each token's counts. From these, one
pass builds the EM histogram (events binned by bucket and by the octaves of their estimates, with the mean logarithms in
each bin: a table bounded by its bins, not by the data) and a second one scores. Counts cover all documents. Bigrams and
trigrams go by hashes of sixteen bits more than the corpus has tokens, words by 64 bits.

Defined results: null text is the empty text, whose only token is the end; null ids count as training rows; repeated ids are
rows of their own. Without training rows, the estimates are uniform. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import MULTIPLIERS, discard, materialize, mixed, read_table, release, row_crc, word_hashes
from docloom.llm.exchange import ASK_DDL, CHUNK_BYTES, ask_table, chunk_documents, compress, doc_columns, expand, gathered, look_up, pack_keys, pack_numbers, rows_of, unpack_counts, unpack_keys, unpack_numbers

FOLDS, HELD_OUT = 5, 1
#: The end token, which also is the context of a text's first token: fixed value outside any word's likely hash.
END = np.uint64(0x5A17C0DE0000E0D5)
#: Bins an octave, of trigram, bigram and unigram estimates over the uniform one, and the bins of each.
_FINE, _SPAN = (2, 2, 1), 128
_WORDS, _PAIRS, _TRIPLES = 1, 2, 3


def encode_words(texts: list[bytes]) -> bytes:
    """A chunk's body: distinct token hashes (sorted), a code for each token, tokens of each document."""
    parts, counts = [], []
    for t in texts:
        h = word_hashes(t)
        parts += [h, [END]]
        counts.append(len(h) + 1)
    keys, codes = np.unique(np.concatenate(parts).astype(np.uint64), return_inverse=True)
    blobs = [pack_keys(keys), pack_numbers(codes), compress(np.array(counts, "<i8").tobytes())]
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def decode_words(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, codes, tokens of each document)."""
    blobs, at = [], 0
    for _ in range(3):
        n = int.from_bytes(body[at : at + 8], "little")
        blobs.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return unpack_keys(blobs[0]), unpack_numbers(blobs[1]).astype(np.int64), np.frombuffer(expand(blobs[2]), "<i8")


def is_held_out(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    crc = np.array([row_crc(None if n else int(i)) for i, n in zip(ids, nulls, strict=True)], np.int64)
    return (crc % FOLDS == HELD_OUT) & ~nulls


def gram_keys(keys: np.ndarray, codes: np.ndarray, counts: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first tokens' places, bigram key and trigram key of each token); before a text stand two end tokens."""
    starts = np.cumsum(counts) - counts
    h = keys[codes]
    v = np.empty_like(h)
    v[1:], v[starts] = h[:-1], END
    u = np.empty_like(h)
    u[1:], u[starts] = v[:-1], END
    pairs = mixed(v * MULTIPLIERS[0] + h * MULTIPLIERS[1])
    return starts, pairs & mask, mixed(u * MULTIPLIERS[2] + pairs) & mask


def _ask(chunks: DataFrame, mask: np.uint64) -> DataFrame:
    """Each chunk's distinct words, bigrams and trigrams with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                ids, _, nulls = doc_columns(row)
                keys, codes, counts = decode_words(row["body"])
                train = np.repeat(~is_held_out(ids, nulls), counts)
                yield from ask_table(_WORDS, row["chunk"], keys, [np.bincount(codes[train], minlength=len(keys))]).to_batches()
                _, pairs, triples = gram_keys(keys, codes, counts, mask)
                del keys, codes
                for kind, grams in ((_PAIRS, pairs), (_TRIPLES, triples)):
                    # held-out rows ask as well, with counts of zero
                    distinct, place = np.unique(grams, return_inverse=True)
                    seen = np.bincount(place[train], minlength=len(distinct))
                    del place
                    yield from ask_table(kind, row["chunk"], distinct, [seen]).to_batches()
                del row, pairs, triples, grams, distinct, seen
                release()

    return chunks.mapInArrow(run, ASK_DDL)


_COUNTED_DDL = "chunk long, doc_ids binary, nulls binary, tokens binary, totals binary, histogram binary"
_COUNTED = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "nulls", "tokens", "totals", "histogram"))])


def context_counts(c2: np.ndarray, c1: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c(u v) and c(v) of each token; all documents' first tokens follow the end token."""
    end = c1[ends[0] - 1] if len(ends) else 0
    two, one = np.empty_like(c2), np.empty_like(c1)
    two[1:], one[1:] = c2[:-1], c1[:-1]
    two[starts] = one[starts] = end
    return two, one


def bucket_of(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """0: no context is known; 1 + log2 c(u v); or 65 + log2 c(v) where only that is known."""
    log = lambda c: np.log2(np.maximum(c, 1)).astype(np.int64)
    return np.where(two > 0, 1 + log(two), np.where(one > 0, 65 + log(one), 0))


def estimates(c3: np.ndarray, c2: np.ndarray, c1: np.ndarray, two: np.ndarray, one: np.ndarray, n: int, v: int) -> list[np.ndarray]:
    """Trigram, bigram and unigram estimates over the uniform one; unseen contexts give none."""
    return [x / np.maximum(y, 1) * (v + 1) for x, y in ((np.where(two > 0, c3, 0), two), (np.where(one > 0, c2, 0), one), (c1, max(n, 1)))]


def _events(c3: np.ndarray, c2: np.ndarray, c1: np.ndarray, two: np.ndarray, one: np.ndarray, n: int, v: int) -> tuple[np.ndarray, ...]:
    """(bin, events, sums of the estimates' logarithms) of training tokens, each with its own occurrence deleted."""
    two, one = two - 1, one - 1
    ratios = estimates(c3 - 1, c2 - 1, c1 - 1, two, one, n - 1, v)
    logs = [np.log2(np.maximum(r, 2.0**-60)) for r in ratios]
    bins = bucket_of(two, one)
    for r, g, fine in zip(ratios, logs, _FINE, strict=True):
        bins = bins * _SPAN + np.where(r > 0, np.clip(np.round(g * fine) + _SPAN // 2, 1, _SPAN - 1), 0).astype(np.int64)
    bins, place = np.unique(bins, return_inverse=True)
    return (bins, np.bincount(place, minlength=len(bins)), *(np.bincount(place, np.where(r > 0, g, 0), len(bins)) for r, g in zip(ratios, logs, strict=True)))


def _counted(mask: np.uint64, n: int, v: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _COUNTED.empty_table()
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        ids, _, nulls = doc_columns(row)
        keys, codes, counts = decode_words(row["body"])
        starts, pairs, triples = gram_keys(keys, codes, counts, mask)
        total = [gathered(right, _WORDS, 8)[0].astype(np.int64)[codes]]
        for kind, grams in ((_PAIRS, pairs), (_TRIPLES, triples)):
            total.append(gathered(right, kind, 8)[0].astype(np.int64)[np.unique(grams, return_inverse=True)[1]])
        del keys, codes, pairs, triples, grams
        c1, c2, c3 = total
        two, one = context_counts(c2, c1, np.cumsum(counts), starts)
        train = np.repeat(~is_held_out(ids, nulls), counts)
        events = _events(*(x[train] for x in (c3, c2, c1, two, one)), n, v)
        values = [row["chunk"], row["doc_ids"], row["nulls"], compress(counts.astype("<i8").tobytes())]
        values.append(b"".join(len(p).to_bytes(4, "little") + p for p in (pack_numbers(x, 8) for x in (c3, c2, c1))))
        values.append(compress(np.column_stack([x.astype("<f8") for x in events]).tobytes()))
        del total, c1, c2, c3, two, one, events, train
        release()
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(values, _COUNTED, strict=True)], schema=_COUNTED)

    return run


def learn_weights(bins: np.ndarray, n: np.ndarray, logs: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, [trigram, bigram, unigram, uniform]) by EM; a bucket with few events leans on the pooled weights of its kind."""
    seen = np.column_stack([bins // _SPAN**2, bins // _SPAN, bins])[:, :3] % _SPAN > 0
    p = np.column_stack([np.where(seen, 2.0 ** (logs / n[:, None]), 0.0), np.ones(len(bins))]) if len(bins) else np.ones((0, 4))
    bucket = bins // _SPAN**3

    def em(p: np.ndarray, n: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        a = start.copy()
        for _ in range(rounds):
            share = p * a
            share /= share.sum(1, keepdims=True)
            a = (share * n[:, None]).sum(0) + prior * start
            a /= a.sum()
        return np.maximum(a, 1e-6) / np.maximum(a, 1e-6).sum()

    out = np.zeros((130, 4))
    for kind, first, last in ((0, 0, 1), (1, 1, 65), (2, 65, 130)):
        start = np.array([0.25, 0.25, 0.25, 0.25]) * ([0, 0, 1, 1], [1, 1, 1, 1], [0, 1, 1, 1])[kind]
        mine = (bucket >= first) & (bucket < last)
        pooled = em(p[mine], n[mine], start / start.sum(), 1.0) if mine.any() else start / start.sum()
        out[first:last] = pooled
        for b in np.unique(bucket[mine]):
            out[b] = em(p[bucket == b], n[bucket == b], pooled, 20.0)
        out[first:last] *= start > 0  # an unseen context leaves its weight to the others
    return out / out.sum(1, keepdims=True)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    chunks = chunk_documents(docs, encode_words, id_col, text_col, name="word-chunks")
    count = chunks.count()
    # two bytes of text are a token at most; sixteen bits more than all tokens need
    mask = np.uint64((1 << 64) - (1 << max(0, 48 - (max(count, 1) * CHUNK_BYTES // 2).bit_length()) // 8 * 8))
    answers = materialize(look_up(_ask(chunks, mask), count, lambda totals: totals, 8), "counts")
    sums = answers.where(F.col("node").isNull() & (F.col("kind") == _WORDS)).agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)).alias(c) for k, c in enumerate("nv")))
    n, v = sums.first()
    both = chunks.groupBy("chunk").cogroup(answers.where("node is not null").select("kind", "bucket", "node", "counts").groupBy("node"))
    counted = materialize(both.applyInArrow(_counted(mask, n, v), _COUNTED_DDL), "token-counts")
    del both, sums
    discard(chunks, answers)
    bins = pa.schema([("bin", pa.int64()), *((c, pa.float64()) for c in ("n", "l3", "l2", "l1"))])

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0):
                rows = np.frombuffer(expand(h.as_py()), "<f8").reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int64)), *(pa.array(rows[:, k]) for k in range(1, 5))], schema=bins)

    binned = counted.select("histogram").mapInArrow(events, "bin long, n double, l3 double, l2 double, l1 double")
    table = binned.groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("n", "l3", "l2", "l1"))).toPandas().sort_values("bin")  # bounded by the bins
    learnt = learn_weights(table["bin"].to_numpy(np.int64), table["n"].to_numpy(np.float64), table[["l3", "l2", "l1"]].to_numpy(np.float64))
    weights = spark.sparkContext.broadcast(learnt)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = weights.value
        for b in batches:
            for row in rows_of(b):
                ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)
                tokens = np.frombuffer(expand(row["tokens"]), "<i8")
                c3, c2, c1 = (x.astype(np.int64) for x in unpack_counts(row["totals"], 8))
                ends = np.cumsum(tokens)
                starts = ends - tokens
                two, one = context_counts(c2, c1, ends, starts)
                w = a[bucket_of(two, one)]
                p = w[:, 3].copy()
                for k, ratio in enumerate(estimates(c3, c2, c1, two, one, n, v)):
                    p += w[:, k] * ratio
                base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
                sums = [np.add.reduceat(x, starts) for x in (base, np.log10(p / (v + 1)), (c1 > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(is_held_out(ids, nulls)), pa.array(tokens), pa.array(sums[2]), pa.array(np.full(len(ids), n, np.int64)), pa.array(sums[0]), pa.array(sums[1])], schema=schema)
                del row, c3, c2, c1, two, one, w, p, base
                release()

    return counted.select("doc_ids", "nulls", "tokens", "totals").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
