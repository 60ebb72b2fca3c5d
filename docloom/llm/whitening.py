"""Embedding whitening: principal components of integer-valued vectors, scaled to unit variance.

Components of a vector, as double, become integers ``x = floor(scale * c) + shift``. One pass sums them exactly (64-bit within a
partition, decimals across). Rows centred by these exact sums go through Spark MLlib's ``RowMatrix``, whose ``computeGramianMatrix``
divided by n is the covariance; the driver, which holds d x d numbers only, takes its eigenvectors (``eigh``) and broadcasts them,
and ``mapInPandas`` projects each row. ``identity_error`` measures what came out: the covariance of the whitened rows, once more by
``RowMatrix`` over centred rows, against the identity.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length than
most vectors have (ties: the longer); null and repeated ids stay as they are; entries beyond 2^50 / scale count as that; a vector in many
copies counts as often. Components without variance (up to rounding) have ``whitened`` null and no part in ``identity_error``, which is
null if none has any; without variance at all ``explained`` is null. ``deviation`` is null where it does not fit 64 bits. No usable row
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read_table

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
LARGEST = 2.0**50


def usable_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of double) for each length of the finite, filled vectors in an array of lists."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    size = np.maximum(length, 0)
    start = np.cumsum(size) - size
    bad = length < 0
    bad[np.repeat(np.arange(len(length)), size)[~np.isfinite(flat)]] = True
    for d in np.unique(length[~bad]):
        rows = np.flatnonzero(~bad & (length == d))
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def integers(vectors: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * vectors), -LARGEST, LARGEST).astype(np.int64) + shift


def _totals(vectors: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """(n, sums) of the most frequent length: a row for each length, partition and dimension is all that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for rows, v in usable_rows(b.column(0)):
                x = integers(v, scale, shift)
                n, s = held.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                held[x.shape[1]] = n + len(rows), s + x.sum(0).astype(object)
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "k": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([str(y) for y in s], pa.string())})

    part = vectors.mapInArrow(run, "d int, k int, n long, s string")
    sums = part.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = sums.groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("d")).first()
    return (0, []) if best is None else (best.n, [int(r.s) for r in best.sums])


def _gramian(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """Covariance of n centred rows (one column of arrays of d doubles): MLlib's Gramian over n. Rows stay in the JVM."""
    v = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(v, n, d).computeGramianMatrix().toArray() / n


@dataclass
class Centring:
    """Exact centre of n integer rows: ``n * x - sums`` is exact as long as it fits 64 bits, and in Python's integers beyond."""

    n: int
    sums: list[int]
    scale: float
    shift: int

    def deviations(self, vectors: np.ndarray) -> np.ndarray:
        base = [s // self.n for s in self.sums]
        near = integers(vectors, self.scale, self.shift) - np.array(base, np.int64)
        if near.size and int(np.abs(near).max()) * self.n >= 2**62:
            near = near.astype(object)
        return near * self.n - np.array([s - b * self.n for s, b in zip(self.sums, base, strict=True)], near.dtype)

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        return self.deviations(vectors).astype(np.float64) / self.n


@dataclass
class Whitening:
    """What ``fit`` found: the centre, eigenvalues and unit eigenvectors (columns) by falling eigenvalue, the covariance's trace."""

    centre: Centring
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def alive(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > self.trace * len(self.centre.sums) * np.finfo(float).eps

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]

    def transform(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(vec_id, deviation, whitened: array<double>) of every usable row."""
        alive = self.alive
        weights = np.where(alive, self.vectors / np.sqrt(np.where(alive, self.values, 1.0)), np.nan)
        shared = df.sparkSession.sparkContext.broadcast((self.centre, weights))  # d x components numbers

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre, w = shared.value
            for frame in frames:
                ids, found = frame["id"].to_numpy(), pa.array(frame["v"], pa.list_(pa.float64()))
                for rows, v in usable_rows(found):
                    if v.shape[1] != len(centre.sums):
                        continue
                    d = centre.deviations(v)
                    exact = d if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2**63 else d.astype(object)
                    squares = [int(s) if s < 2**63 else None for s in (exact * exact).sum(1)]
                    white = (d.astype(np.float64) / centre.n) @ w
                    yield pd.DataFrame({"id": ids[rows], "deviation": pd.array(squares, "Int64"), "whitened": [[None if np.isnan(y) else y for y in r] for r in white.tolist()]})

        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return rows.mapInPandas(run, "id string, deviation long, whitened array<double>").select(F.col("id").cast("long").alias("vec_id"), "deviation", "whitened")

    def identity_error(self, whitened: DataFrame) -> float | None:
        """Largest absolute entry of the whitened rows' covariance minus the identity; ``whitened`` is what ``transform`` gave."""
        kept = np.flatnonzero(self.alive)
        if not len(kept):
            return None
        w = [F.col("whitened")[int(k)] for k in kept]
        mean = whitened.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(w)]).first()
        cov = _gramian(whitened.select(F.array(*[c - F.lit(m) for c, m in zip(w, mean, strict=True)]).alias("v")), self.centre.n, len(kept))
        return float(np.abs(cov - np.eye(len(kept))).max())


def fit(df: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT, vector_col: str = "embedding") -> Whitening | None:
    """The first ``components`` principal components over all usable vectors of ``df``; None where there is none."""
    vectors = df.select(F.col(vector_col).cast("array<double>").alias("v"))
    n, sums = _totals(vectors, scale, shift)
    if not n:
        return None
    centre = Centring(n, sums, scale, shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, v in usable_rows(b.column(0)):
                if v.shape[1] == len(centre.sums):
                    c = centre.centred(v)
                    ends = np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_pydict({"v": pa.ListArray.from_arrays(pa.array(ends), pa.array(c.ravel()))})

    cov = _gramian(vectors.mapInArrow(run, "v array<double>"), n, len(sums))
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, basis = np.maximum(values[order], 0.0), basis[:, order]
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])  # the largest entry of each component is positive
    return Whitening(centre, values, basis * np.where(sign == 0, 1.0, sign), float(np.trace(cov)))


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    model = fit(df, components, vector_col=vector_col)
    if model is None:
        none = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], none)
    rows = materialize(model.transform(df, id_col, vector_col), "whitened")
    error = model.identity_error(rows)
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained])
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
