"""Toxicity by non-negative positive-unlabelled learning (nnPU) with numpy classifiers.

Confirmed toxic rows are positives; all other training text, whether labelled 0 or not at all, is *unlabelled*: it may
hold toxic rows. With the class prior p and the logistic loss, the risk is

    p * mean_P loss(+)  +  max(0, mean_U loss(-) - p * mean_P loss(-))

where the second part estimates the negatives' risk; when it falls below zero the step only undoes that (the
non-negative correction). The class prior is the toxic share of the labelled training rows, which is all that labels of 0 are
read for. Raw scores become probabilities by the same risk over positives and unlabelled rows, each scored by weights that were
learnt without its part of the sample.

Training uses a bounded sample (documented parameters): at most ``max_positive`` toxic rows and ``max_unlabelled`` others,
those with the smallest hash of the id, which is the same on every run and at every size. Scoring covers all rows and whole
texts. Features are hashes of a text's distinct words (lower-cased, stripped of ASCII punctuation) and of their beginnings
and inner character runs, so that inflected and compound forms of a word are known by its stem. Only those features
are kept whose share among positives differs significantly from that among unlabelled rows; a toxic word therefore counts
the same in a short text and in a very long one.

Defined results: null text counts as empty and is scored by the bias alone; rows without id are scored but never learnt from;
labels of null are no labels; repeated label rows count once (toxic if any says so); without a toxic or any unlabelled row
every score is the prior.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import read_table, release, spread

DIM, THRESHOLD = 1 << 20, 0.3
#: Parts of the sample for raw scores of rows that the weights haven't seen, and the pull of the slope towards 1.
PARTS, RIDGE = 4, 1e-3
MAX_POSITIVE, MAX_UNLABELLED = 2_000, 4_000
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_features(word: bytes) -> list[int]:
    """Slots of a word: itself, its beginnings of 4 to 6 bytes and its runs of 5 bytes."""
    w = word.strip(_STRIP)
    parts = [b"=" + w, *(b"^" + w[:n] for n in (4, 5, 6) if len(w) > n), *(w[i : i + 5] for i in range(1, len(w) - 4))]
    return [zlib.crc32(p) % DIM for p in parts]


class Extractor(dict):
    """Word -> its slots as bytes, those that ``kept`` holds (all by default); starts anew when full."""

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        slots = np.array(word_features(word), "<u4")
        found = self[word] = (slots if self.kept is None else slots[self.kept[slots]]).tobytes()
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a whole text."""
        words = (text or "").encode().lower().split()
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")).astype(np.int64)


@dataclass
class Model:
    """weights: a logit for each feature, 0 for those not kept; a text's raw score is the sum over its distinct features."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    prior: float

    def raw(self, slots: np.ndarray) -> float:
        return self.bias + float(self.weights[slots].sum())

    def probability(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(slots) + self.shift, -30, 30))))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int = 4, z: float = 4.0) -> np.ndarray:
    """Mask of features in ``least`` positives or more whose two shares lie ``z`` standard errors apart."""
    p, u = np.zeros(DIM), np.zeros(DIM)
    for counts, rows in ((p, positive), (u, unlabelled)):
        for r in rows:
            counts[r] += 1  # a row's features are distinct
    n, m = len(positive), len(unlabelled)
    both = (p + u) / (n + m)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n + 1 / m))
    return (p >= least) & (np.abs(p / n - u / m) >= z * error)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, rate: float = 0.3, l2: float = 2e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by mini-batch Adagrad over sparse rows."""
    rng = np.random.default_rng(seed)
    keep = telling(positive, unlabelled)
    rows_p, rows_u = ([s[keep[s]] for s in rows] for rows in (positive, unlabelled))
    w, b, g2, gb2 = np.zeros(DIM), 0.0, np.full(DIM, 1e-8), 1e-8
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    size_p, size_u = min(256, len(rows_p)), min(1024, len(rows_u))
    for _ in range(epochs):
        order_u = rng.permutation(len(rows_u))
        for lo in range(0, len(rows_u), size_u):
            chosen_u = [rows_u[i] for i in order_u[lo : lo + size_u]]
            chosen_p = [rows_p[i] for i in rng.choice(len(rows_p), size_p, replace=False)]
            flat, row = pack(chosen_p + chosen_u)
            z = np.bincount(row, w[flat], len(chosen_p) + len(chosen_u)) + b
            zp, zu = z[: len(chosen_p)], z[len(chosen_p) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            slope = np.zeros(len(z))
            if negative >= 0:
                slope[: len(zp)] = (prior * (sigmoid(zp) - 1) - prior * sigmoid(zp)) / len(zp)
                slope[len(zp) :] = sigmoid(zu) / len(zu)
            else:  # the estimated negative risk is below zero: climb back
                slope[: len(zp)] = prior * sigmoid(zp) / len(zp)
                slope[len(zp) :] = -sigmoid(zu) / len(zu)
            gradient = np.bincount(flat, slope[row], DIM) + l2 * w
            g2 += gradient * gradient
            w -= rate * gradient / np.sqrt(g2)
            step = slope.sum()
            gb2 += step * step
            b -= rate * step / np.sqrt(gb2)
    return w, b


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of raw scores that minimise the same risk (Newton steps, damped); no label 0 is needed.

    With the logistic loss and two parameters the risk is mean_U softplus(z) - p * mean_P z, which is convex. At its
    minimum the unlabelled rows' mean probability is the prior.
    """
    both = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled) or both.std() == 0:
        return 1.0, 0.0
    centre, spread = both.mean(), both.std()
    xp, xu = (np.column_stack([(x - centre) / spread, np.ones(len(x))]) for x in (positive, unlabelled))
    start = beta = np.array([spread, centre])  # the raw scores as they are
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(xu @ beta, -30, 30)))
        gradient = xu.T @ p / len(xu) - prior * xp.mean(0) + RIDGE * (beta - start) * [1, 0]
        hessian = (xu * (p * (1 - p))[:, None]).T @ xu / len(xu) + np.diag([RIDGE, 1e-6])
        move = np.linalg.solve(hessian, gradient)
        beta = beta - move * min(1.0, 1 / (np.abs(move).max() + 1e-9))
    scale = max(beta[0], 0.0) / spread
    return float(scale), float(beta[1] - scale * centre)


def in_held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Train on the sample described above; only labels of rows outside the held-out fold are read."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_held_out("doc_id")).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), sum(n for t, n in counts.items() if t != 1)
    prior = min(max(toxic / max(toxic + clean, 1), 1e-3), 0.9)
    rank = F.xxhash64(F.col("__id"), F.lit(11))
    positive = marks.where("toxic = 1").orderBy(rank, "__id").limit(max_positive)
    # labelled rows and others alike: a row's hash decides
    ids = docs.where(F.col(id_col).isNotNull() & ~in_held_out(id_col)).select(F.col(id_col).cast("long").alias("__id"))
    unlabelled = ids.orderBy(rank, "__id").limit(max_unlabelled).distinct()
    wanted = (
        positive.select("__id", F.lit(1).alias("p"), F.lit(0).alias("u"))
        .unionByName(unlabelled.select("__id", F.lit(0).alias("p"), F.lit(1).alias("u")))
        .groupBy("__id")
        .agg(F.max("p").alias("p"), F.max("u").alias("u"))
    )
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "__id")
    schema = pa.schema([("id", pa.int64()), ("p", pa.int32()), ("u", pa.int32()), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for b in batches:
            slots = [extract.of(t.as_py()).astype("<u4").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("__id"), *(b.column(c).cast(pa.int32()) for c in "pu"), pa.array(slots, pa.binary())], schema=schema)
        extract.clear()
        release()

    # bounded by the sample's size; kept as one Arrow table, of which the rows below are views
    table = sample.mapInArrow(run, "id long, p int, u int, slots binary").toArrow().sort_by("id")
    ids, marked, drawn = (table.column(c).to_numpy() for c in ("id", "p", "u"))
    data = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("slots")]
    if not marked.any() or not drawn.any():
        return Model(np.zeros(DIM), 0.0, 0.0, float(np.log(prior / (1 - prior))), prior)
    part = np.array([zlib.crc32(f"{i} part".encode()) % PARTS for i in ids.tolist()])

    def learnt(rows: np.ndarray) -> Model | None:
        chosen = [[data[k] for k in np.flatnonzero(rows & (m == 1))] for m in (marked, drawn)]
        return Model(*train(*chosen, prior), 1.0, 0.0, prior) if all(chosen) else None

    raw: list[list[float]] = [[], []]
    for k in range(PARTS):
        if (other := learnt(part != k)) is not None:
            for scores, m in zip(raw, (marked, drawn), strict=True):
                scores += [other.raw(data[i]) for i in np.flatnonzero((part == k) & (m == 1))]
    model = learnt(part >= 0)
    model.scale, model.shift = calibrate(*map(np.array, raw), prior)
    del table, data
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        extract = Extractor(known.weights != 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([known.probability(extract.of(t.as_py())) for t in b.column(2)], pa.float64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), in_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        extract = Extractor(known.weights != 0)
        for b in batches:
            keep = [known.probability(extract.of(t.as_py())) < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
