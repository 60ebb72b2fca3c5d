"""Chunk tables and key look-ups: how an operator asks the whole corpus about each of its keys without shuffling rows.

A *chunk* is one row that holds a few megabytes of documents in packed form, written once to the shared folder. Each
chunk sends its distinct 64-bit keys, packed and sorted, to ``FAN`` hash ranges, whatever the input's size; a range merges the
keys of all chunks (a key's count is summed there, chunk by chunk, so a hot key is one entry a chunk and never a hot group),
and sends back to each chunk one value a key, in the chunk's own order. What crosses the network is a few bytes a
*distinct* key and chunk.

Beyond ``GROUP`` chunks this goes by levels, as in a radix sort: chunks form groups of about ``GROUP``; a range merges the keys
of one group only and asks, in its turn, ``FAN`` finer ranges of the level above; answers come down the same way. Rows are so
``FAN`` for each chunk on every level (in proportion to the input, never to its square), and a range holds
``GROUP / FAN`` chunks' keys at most, on every level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, release, spread

CHUNK_BYTES = 8 << 20

CHUNK_DDL = "chunk long, doc_ids binary, lengths binary, nulls binary, body binary"
_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("nulls", pa.binary()), ("body", pa.binary())])


#: One of each for a worker process: to make them anew costs more than to use them on a few kilobytes.
_COMPRESSOR, _EXPANDER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def compress(data: bytes) -> bytes:
    return _COMPRESSOR.compress(data)


def expand(data: bytes) -> bytes:
    return _EXPANDER.decompress(data)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane (the high ones are nearly all zero)."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_numbers(values: np.ndarray, width: int = 4) -> bytes:
    """Non-negative numbers of ``width`` bytes (8 for totals over the corpus), byte plane by byte plane."""
    return compress(np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def unpack_numbers(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def chunk_documents(docs: DataFrame, encode: Callable[[list[bytes]], bytes], id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, name: str = "chunks") -> DataFrame:
    """Rows of ``CHUNK_DDL``, stored: ids, lengths in bytes and ``encode(texts)`` of consecutive documents.

    A chunk closes at ``chunk_bytes`` of text; one longer document makes a longer chunk. Null texts are empty, null ids flagged.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> pa.RecordBatch:
            null = np.array([i is None for i in ids], np.uint8)
            packed = (np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), null.tobytes(), encode(texts))
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([p], pa.binary()) for p in packed)], schema=_CHUNK)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1]) + 16
                if size >= chunk_bytes:
                    yield close()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield close()

    return materialize(spread(rows).mapInArrow(run, CHUNK_DDL), name)


def doc_columns(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, null flags) of a chunk row."""
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time as Python values, so that one payload is unpacked at once."""
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def range_of(keys: np.ndarray, ranges: int, first: int = 0, total: int | None = None) -> np.ndarray:
    """Cut points of *sorted* keys into ``ranges`` of the ``total`` equal hash ranges, from number ``first`` on; all keys lie in them."""
    edges = (np.arange(first + 1, first + ranges, dtype=object) * (1 << 64) // (total or ranges)).astype(np.uint64) if ranges > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


#: Hash ranges that each node (a chunk, or a range of a group of chunks) asks, and nodes that ask a range.
FAN, GROUP = 128, 256

ASK_DDL = "kind int, bucket long, node long, keys binary, counts binary"
ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER_DDL = "kind int, bucket long, node long, counts binary, sums array<long>"
_ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("node", pa.int64()), ("counts", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _framed(blobs: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(4, "little") + b for b in blobs)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ask_table(kind: int, node: int, keys: np.ndarray, counts: list[np.ndarray], width: int = 4, above: int = 0, level: int = 1, fan: int | None = None) -> pa.Table:
    """A node's sorted distinct keys with their counts, cut into the ranges of its level; ``above`` is the range that holds all of them."""
    fan = fan or FAN
    cuts = range_of(keys, fan, above * fan, fan**level)
    rows = []
    for r in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[r], cuts[r + 1])
        rows.append((kind, above * fan + int(r), node, pack_keys(keys[own]), _framed([pack_numbers(c[own], width) for c in counts])))
    return _table(rows, ASK)


def unpack_counts(data: bytes, width: int = 4) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(unpack_numbers(data[at + 4 : at + 4 + n], width))
        at += 4 + n
    return out


def _merged(table: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A range's distinct keys, their summed counts, and for each row the places of its keys."""
    keys = [unpack_keys(k.as_py()) for k in table.column("keys")]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    parts = [unpack_counts(c.as_py(), width) for c in table.column("counts")]
    totals = []
    for k in range(len(parts[0])):
        total, at = np.zeros(len(distinct), np.int64), 0
        for p in parts:
            total[place[at : at + len(p[k])]] += p[k].astype(np.int64)  # a row's keys are distinct
            at += len(p[k])
        totals.append(total)
    return distinct, totals, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def look_up(asks: DataFrame, nodes: int, finish: Callable[[list[np.ndarray]], list[np.ndarray]], answer_width: int, level: int = 1, fan: int | None = None, group: int | None = None) -> DataFrame:
    """``ANSWER_DDL`` rows for the rows of ``asks``: for each key ``finish(its counts' totals over all nodes)``, in order.

    Rows without node carry, for each count, (its sum over all keys, keys whose total isn't zero). ``nodes`` is the number of
    nodes that ask a range at most. Totals are 64-bit.
    """
    fan, group, width = fan or FAN, group or GROUP, 4 if level == 1 else 8
    if nodes <= group:

        def answer(table: pa.Table) -> pa.Table:
            kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
            _, totals, places = _merged(table, width)
            values = [v.astype(f"<u{answer_width}") for v in finish(totals)]
            rows = [(kind, bucket, node, _framed([pack_numbers(v[p], answer_width) for v in values]), None) for node, p in zip(table.column("node").to_pylist(), places, strict=True)]
            rows.append((kind, bucket, None, None, [int(x) for t in totals for x in (t.sum(), np.count_nonzero(t))]))
            del totals, places, values
            release()
            return _table(rows, _ANSWER)

        return asks.groupBy("kind", "bucket").applyInArrow(answer, ANSWER_DDL)

    groups = -(-nodes // group)
    asks = materialize(asks.withColumn("grp", F.pmod(F.xxhash64("node", F.lit(level)), F.lit(groups))), f"asks-{level}")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        kind, bucket, grp = (k.as_py() for k in key)
        distinct, totals, _ = _merged(table, width)
        out = ask_table(kind, grp, distinct, totals, 8, bucket, level + 1, fan)
        release()
        return out

    upper = materialize(look_up(asks.groupBy("kind", "bucket", "grp").applyInArrow(merge, ASK_DDL), groups, finish, answer_width, level + 1, fan, group), f"answers-{level}")

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ANSWER.empty_table()
        kind, bucket = left.column("kind")[0].as_py(), left.column("bucket")[0].as_py()
        values = gathered(right, kind, answer_width)
        _, _, places = _merged(left, width)
        rows = [(kind, bucket, node, _framed([pack_numbers(v[p], answer_width) for v in values]), None) for node, p in zip(left.column("node").to_pylist(), places, strict=True)]
        del values, places
        release()
        return _table(rows, _ANSWER)

    told = upper.where("node is not null").withColumn("over", F.expr(f"bucket div {fan}"))
    down = asks.groupBy("kind", "bucket", "grp").cogroup(told.groupBy("kind", "over", "node")).applyInArrow(spread, ANSWER_DDL)
    return down.unionByName(upper.where("node is null"))


def gathered(answers: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """A node's answers of one kind, in the order of its sorted keys."""
    rows = sorted((b, k) for k, (n, b) in enumerate(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), strict=True)) if n == kind)
    found = [unpack_counts(answers.column("counts")[k].as_py(), width) for _, k in rows]
    return [np.concatenate(x) for x in zip(*found, strict=True)]
