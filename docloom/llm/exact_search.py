"""Exact top-k search by inner product: a vector-approximation file, scanned for bounds before any exact vector is read.

The file is a table in the shared folder. A row is a block of up to ``BLOCK`` vectors of one dimension: their exact integers
(``floor(scale * c)``, in the fewest bytes), a quantised cell of 4 bits for each entry, and the least and largest integer that each cell of
each dimension holds. Cells follow the block's own quantiles, so bounds are valid whatever the data.

Queries are met with blocks in one pass: a grid of query groups (at most about ``GROUP`` queries, so memory is bounded) by lanes of blocks. A
task reads its group, then streams the lane's blocks past it. For each block it bounds all scores from the cells, takes the kth largest
lower bound and the kth score so far as threshold, and reads exact vectors in order of their upper bounds until the kth score is
larger than all bounds that are left. A task emits k rows a query; a window over the query then ranks what the lanes found.
Nothing passes through the driver but two counts.

Defined results: ``usable_rows`` says which vectors take part (not null, finite entries; empty ones do, and meet each other with score 0);
vectors of different lengths are never compared; a query is a row, so rows that repeat a query's id are queries of their own under that
id, and candidates of each other; null ids are no queries, but candidates, after all ids among equal scores; entries beyond
``largest(d)`` count as that, so that scores fit 64 bits; no query or no candidate gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read_table
from docloom.llm.whitening import usable_rows

SCALE, TOP, EVERY = 64.0, 20, 20
#: Below every score (those fit 63 bits), and its negative fits too.
NONE = -(2**62) - 1
BLOCK, TILE, CELLS = 4096, 256, 16
#: Queries of a group, vectors for each lane, and lanes at most; beyond that lanes get longer.
GROUP, LANE, LANES = 32_768, 2048, 256
FILE_DDL = "part int, nth int, d int, n int, asked int, ids binary, missing binary, queries binary, width int, exact binary, cells binary, low binary, high binary"
FOUND_DDL = "owner long, query_id long, vec_id long, score long"


def largest(d: int) -> int:
    return math.isqrt(2**62 // max(d, 1))


def narrowest(x: np.ndarray) -> np.ndarray:
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, high): the cell of each entry, and the least and largest integer of each cell (d x CELLS)."""
    n, d = x.shape
    ordered = np.sort(x, axis=0)
    low = ordered[np.arange(CELLS) * n // CELLS].T.copy()  # cells of about equally many entries
    high, cells = low.copy(), np.empty((n, d), np.uint8)
    for j in range(d):
        cells[:, j] = np.searchsorted(low[j], x[:, j], "right") - 1
        high[j, np.searchsorted(low[j], ordered[:, j], "right") - 1] = ordered[:, j]  # in rising order: the last one stays
    return cells, low, high


def packed(cells: np.ndarray) -> bytes:
    """Two cells a byte."""
    even = cells if cells.shape[1] % 2 == 0 else np.pad(cells, ((0, 0), (0, 1)))
    return (even[:, 0::2] | even[:, 1::2] << 4).tobytes()


def unpacked(data: bytes, n: int, d: int) -> np.ndarray:
    half = np.frombuffer(data, np.uint8).reshape(n, (d + 1) // 2)
    return np.stack([half & 15, half >> 4], axis=2).reshape(n, -1)[:, :d]


def approximation_file(df: DataFrame, is_query: Column, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The stored blocks of all usable rows; ``is_query`` marks the rows that ask. Blocks fill up over Arrow batches."""
    rows = df.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, open_ = TaskContext.get().partitionId(), 0, {}

        def block(d: int, held: list) -> dict:
            x = np.concatenate([h[0] for h in held])
            ids, missing, asks = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            cells, low, high = quantised(x)
            exact = narrowest(x)
            return {"part": part, "nth": count, "d": d, "n": len(x), "asked": int(asks.sum()), "ids": ids.tobytes(), "missing": np.packbits(missing).tobytes(), "queries": np.packbits(asks).tobytes(),
                    "width": exact.itemsize, "exact": exact.tobytes(), "cells": packed(cells), "low": low.tobytes(), "high": high.tobytes()}

        schema = pa.schema([(n, {"int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in FILE_DDL.split(", "))])
        for b in batches:
            ids, asks = b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for at, v in usable_rows(b.column(0)):
                d = v.shape[1]
                x = np.clip(np.floor(scale * v), -largest(d), largest(d)).astype(np.int64)
                for k in range(0, len(at), BLOCK):
                    rows_ = at[k : k + BLOCK]
                    held = open_.setdefault(d, [])
                    if held and sum(len(h[0]) for h in held) + len(rows_) > BLOCK:
                        yield pa.RecordBatch.from_pylist([block(d, open_.pop(d))], schema=schema)
                        count += 1
                    open_.setdefault(d, []).append((x[k : k + BLOCK], ids[rows_], missing[rows_], asks[rows_] & ~missing[rows_]))
        for d, held in open_.items():
            yield pa.RecordBatch.from_pylist([block(d, held)], schema=schema)
            count += 1

    return materialize(rows.mapInArrow(run, FILE_DDL), "approximation-file")


@dataclass
class _Asked:
    """The queries of one dimension in a group, with the best k candidates of each so far, in rank order."""

    k: int
    home: np.ndarray  # block of each query's own row, its place there, and its id
    place: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    score: np.ndarray = field(init=False)
    found: np.ndarray = field(init=False)
    missing: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.ids), self.k)
        self.score, self.found, self.missing = np.full(shape, NONE), np.zeros(shape, np.int64), np.ones(shape, bool)

    def add(self, q: np.ndarray, score: np.ndarray, found: np.ndarray, missing: np.ndarray) -> None:
        """More candidates (a row of equally many for each of the queries ``q``): the best k of old and new stay."""
        s, i, m = (np.concatenate([old[q], new], axis=1) for old, new in ((self.score, score), (self.found, found), (self.missing, missing)))
        order = np.lexsort((i, m, -s), axis=1)[:, : self.k]
        for old, new in ((self.score, s), (self.found, i), (self.missing, m)):
            old[q] = np.take_along_axis(new, order, axis=1)


@dataclass
class _Block:
    key: int
    ids: np.ndarray
    missing: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray


def search_block(asked: _Asked, block: _Block) -> None:
    """Let a block's vectors into the best k of all queries, tile by tile."""
    n, d = block.x.shape
    bound = d * int(np.abs(asked.x).max(initial=0)) * int(np.abs(block.x).max(initial=0))
    kind = np.float32 if bound < 2**24 else np.float64  # sums of integers below 2^24 (2^53) are exact in either
    slack = 0.0 if bound < 2**53 else bound * d * 2.0**-50
    low, high = block.low.astype(kind), block.high.astype(kind)
    both, turned = np.concatenate([high, low], axis=1).T, np.concatenate([low, high], axis=1).T
    for first in range(0, len(asked.ids), TILE):
        rows = np.arange(first, min(first + TILE, len(asked.ids)))
        q = asked.x[rows].astype(kind)
        signs = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        upper, lower = signs @ both + kind(slack), signs @ turned - kind(slack)
        own = np.flatnonzero(asked.home[rows] == block.key)
        upper[own, asked.place[rows[own]]] = lower[own, asked.place[rows[own]]] = -np.inf
        least = asked.score[rows, -1].astype(np.float64)
        if n >= asked.k:
            least = np.maximum(least, np.partition(lower, n - asked.k, axis=1)[:, n - asked.k])
        # a bound that equals the threshold still counts: its vector may win by a smaller id
        at, column = np.nonzero((upper >= least[:, None]) & (upper > -np.inf))
        bounds = upper[at, column]
        order = np.lexsort((-bounds, at))
        at, column, bounds = at[order], column[order], bounds[order]
        count = np.bincount(at, minlength=len(rows))
        start, read, step = np.cumsum(count) - count, np.zeros(len(rows), np.int64), 2 * asked.k
        while True:
            left = np.flatnonzero(read < count)
            left = left[bounds[start[left] + read[left]] >= asked.score[rows[left], -1]] if len(left) else left
            if not len(left):
                break
            take = read[left][:, None] + np.arange(step)
            real = take < count[left][:, None]
            spot = start[left][:, None] + np.where(real, take, 0)
            vectors = column[spot]
            score = np.einsum("qd,qcd->qc", asked.x[rows[left]].astype(np.int64), block.x[vectors].astype(np.int64))
            asked.add(rows[left], np.where(real, score, NONE), block.ids[vectors], block.missing[vectors] | ~real)
            read[left] += step


def _integers(row: dict) -> np.ndarray:
    return np.frombuffer(row["exact"], f"<i{row['width']}").reshape(row["n"], row["d"])


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _home(row: dict) -> int:
    return row["part"] << 24 | row["nth"]


def scan_lanes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell of the grid, its queries (stage 0) before its blocks (stage 1)."""
    cell, waiting, asked = None, {}, {}

    def results() -> Iterator[pa.RecordBatch]:
        for a in asked.values():
            q, nth = np.nonzero(a.score > NONE)
            gone = a.missing[q, nth]
            owner = (a.home[q] << 12) | a.place[q]
            yield pa.RecordBatch.from_pydict({"owner": pa.array(owner), "query_id": pa.array(a.ids[q]), "vec_id": pa.array(a.found[q, nth], mask=gone), "score": pa.array(a.score[q, nth])})

    for batch in batches:
        for nth in range(batch.num_rows):
            row = {name: column[nth].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if row["cell"] != cell:
                yield from results()
                cell, waiting, asked = row["cell"], {}, {}
            ids, x, d = np.frombuffer(row["ids"], "<i8"), _integers(row), row["d"]
            if row["stage"] == 0:
                waiting.setdefault(d, []).append((np.full(len(x), _home(row)), np.frombuffer(row["queries"], "<u2").astype(np.int64), ids, x))
                continue
            for size, parts in waiting.items():
                kept = np.result_type(*[p[3].dtype for p in parts])
                asked[size] = _Asked(k, *(np.concatenate([p[j] for p in parts]) for j in range(3)), np.concatenate([p[3].astype(kept) for p in parts]))
            waiting = {}
            if d in asked:
                low, high = (np.frombuffer(row[c], "<i8").reshape(d, CELLS) for c in ("low", "high"))
                cells, entry = unpacked(row["cells"], row["n"], d), np.arange(d)
                search_block(asked[d], _Block(_home(row), ids, _bits(row["missing"], row["n"]), x, low[entry, cells], high[entry, cells]))
    yield from results()


def query_rows(file: DataFrame) -> DataFrame:
    """The blocks' queries alone, in the file's own form; ``queries`` holds their places in the block (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                place = np.flatnonzero(_bits(row["queries"], row["n"]))
                own = {"n": len(place), "queries": place.astype("<u2").tobytes(), "ids": np.frombuffer(row["ids"], "<i8")[place].tobytes(), "exact": _integers(row)[place].tobytes()}
                yield pa.RecordBatch.from_pylist([row | own], schema=b.schema)

    kept = ["part", "nth", "d", "n", "ids", "queries", "width", "exact"]
    return file.where("asked > 0").select(kept).mapInArrow(run, ", ".join(c for c in FILE_DDL.split(", ") if c.split()[0] in kept))


def search(file: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of the file its k highest scores over all other rows, ties to the smaller id."""
    size = file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked")).first()
    groups, lanes = max(1, -(-size.asked // GROUP)), min(LANES, max(1, -(-size.n // LANE)))
    group, lane = F.pmod(F.xxhash64("part", "nth"), F.lit(groups)), F.pmod(F.col("part") + F.col("nth"), F.lit(lanes))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = query_rows(file).withColumns({"stage": F.lit(0), "g": group}).withColumn("lane", copies(lanes))
    blocks = file.drop("queries", "asked").withColumns({"stage": F.lit(1), "lane": lane}).withColumn("g", copies(groups))
    rows = asking.unionByName(blocks, allowMissingColumns=True).withColumn("cell", (F.col("g") * lanes + F.col("lane")).cast("int")).drop("g", "lane")
    dealt = rows.repartitionById(groups * lanes, F.col("cell")).sortWithinPartitions("cell", "stage")
    found = dealt.mapInArrow(lambda batches: scan_lanes(batches, k), FOUND_DDL)
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(df: DataFrame, is_query: Column, k: int = TOP, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return search(approximation_file(df, is_query, scale, id_col, vector_col), k)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP13_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY rank <= 20
"""
