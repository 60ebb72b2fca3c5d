"""Token-id files: a static range asymmetric numeral system (rANS) over shared frequency tables.

Writing: documents are range-partitioned by id and tokenized once into a staging table; token counts over *all* of it
give one shared, normalised frequency table; each run of documents becomes a block that is coded on its own. Within a
block, ``LANES`` interleaved coder states take turns over the ids. At every checkpoint the block records all lane states,
its word offset and a CRC of the ids up to the next one, so segments (and blocks) decode in parallel; the whole payload
has a CRC as well. A dataset is two Parquet tables in one folder, ``table`` (token, freq) and ``blocks``: Spark's commit
protocol covers lost executors and any file system, and a block is an opaque payload of this format.

Defined results: null text counts as empty; every document ends with the end id, so empty ones have one token. Rows are
ordered by id (nulls first), then text; repeated ids follow each other. An empty table gives empty files and no rows.
A document never straddles blocks, so a block is as large as its longest document needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bpe import loaded
from docloom.llm.common import read_table, shared_path, tokenizer_path

LANES, BLOCK_TOKENS, CHECKPOINT_STEPS, MAGIC = 1024, 1 << 18, 64, b"DLT1"
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


class FrequencyTable:
    """Frequencies normalised to a power of two, every counted token at least 1."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.freqs = tokens[order].astype(np.int64), freqs[order].astype(np.uint64)
        self.bits = int(self.freqs.sum()).bit_length() - 1 if len(tokens) else 0
        size = int(self.tokens[-1]) + 1 if len(tokens) else 0
        starts = np.concatenate(([0], np.cumsum(self.freqs)[:-1])).astype(np.uint64) if size else np.zeros(0, np.uint64)
        self.f, self.c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.f[self.tokens], self.c[self.tokens] = self.freqs, starts
        self.slot = np.repeat(self.tokens, self.freqs.astype(np.int64)).astype(np.uint32)
        self.filler = int(self.tokens[np.argmax(self.freqs)]) if size else 0

    @classmethod
    def of_counts(cls, tokens: np.ndarray, counts: np.ndarray) -> FrequencyTable:
        if not len(tokens):
            return cls(np.zeros(0, np.int64), np.zeros(0, np.uint64))
        room = 1 << max(20, len(tokens).bit_length() + 2)
        share = np.floor(counts / counts.sum() * (room - len(tokens))).astype(np.int64) + 1
        share[np.argmax(share)] += room - share.sum()
        return cls(tokens, share)


def encode_block(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """One payload: header, checkpoint states, word offsets, segment CRCs, words."""
    n = len(ids)
    lanes = max(1, min(lanes, 1 << max(0, (n // 128).bit_length())))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, table.filler, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    f, c = table.f[grid], table.c[grid]
    limit = f << np.uint64(63 - table.bits)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = [None] * steps
    states, bits = [], np.uint64(table.bits)
    for t in range(steps - 1, -1, -1):
        full = x >= limit[t]
        words[t] = x[full].astype(np.uint32)
        np.right_shift(x, _WORD, out=x, where=full)
        q = x // f[t]
        x = (q << bits) + (x - q * f[t]) + c[t]
        if t % every == 0:
            states.append(x.copy())
    states.reverse()
    counts = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts)))[: steps : every] if steps else np.zeros(0, np.int64)
    flat = ids.astype("<u4")
    crcs = [zlib.crc32(flat[k * every * lanes : (k + 1) * every * lanes].tobytes()) for k in range(len(states))]
    head = MAGIC + struct.pack("<QIIII", n, lanes, every, len(states), table.bits)
    body = [np.asarray(states, "<u8").tobytes(), offsets.astype("<u8").tobytes(), np.asarray(crcs, "<u4").tobytes()]
    return head + b"".join(body) + (np.concatenate(words).astype("<u4").tobytes() if steps else b"")


def decode_block(data: bytes, table: FrequencyTable, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of segments ``first`` to ``last`` (exclusive; all by default), each checked against its CRC."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    n, lanes, every, segments, bits = struct.unpack_from("<QIIII", data, 4)
    if bits != table.bits:
        raise ValueError("block and frequency table do not belong together")
    at = 28
    states = np.frombuffer(data, "<u8", segments * lanes, at).reshape(segments, lanes)
    offsets = np.frombuffer(data, "<u8", segments, at := at + states.nbytes)
    crcs = np.frombuffer(data, "<u4", segments, at := at + offsets.nbytes)
    words = np.frombuffer(data, "<u4", -1, at + crcs.nbytes).astype(np.uint64)
    steps, out = -(-n // lanes), []
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    for k in range(first, segments if last is None else last):
        x, at = states[k].astype(np.uint64), int(offsets[k])
        rows = min(every, steps - k * every)
        got = np.empty((rows, lanes), np.uint32)
        for t in range(rows):
            slot = x & mask
            got[t] = s = table.slot[slot]
            x = table.f[s] * (x >> shift) + slot - table.c[s]
            low = np.flatnonzero(x < _LOW)
            if at + len(low) > len(words):
                raise ValueError(f"segment {k} is damaged")
            x[low] = (x[low] << _WORD) | words[at : at + len(low)]
            at += len(low)
        ids = got.reshape(-1)[: n - k * every * lanes]
        if zlib.crc32(ids.tobytes()) != crcs[k]:
            raise ValueError(f"segment {k} is damaged")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _stage(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, doc_id, at, n_tokens, ids) in id order, ``at`` counted within the part; written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # as many ranges as the rows have bytes for, whatever the session's default
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size >> 26, 1 << 20))
    rows = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, part, at = loaded(path, library=True), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                ids = [np.frombuffer(bpe.encode(t.as_py() or "") + end, "<u4") for t in piece.column(1)]
                n = np.array([len(i) for i in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                narrow = [(i.astype("<u2") if len(bpe.piece) <= 1 << 16 and end_id < 1 << 16 else i).tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), piece.column(0), pa.array(starts), pa.array(n), pa.array(narrow, pa.binary())], schema=schema)

    ddl = "part int, doc_id long, at long, n_tokens long, ids binary"
    target = shared_path(docs.sparkSession, "token-stage")
    rows.mapInArrow(run, ddl).write.option("compression", "zstd").parquet(target)
    return docs.sparkSession.read.schema(ddl).parquet(target)


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _count_tokens(staged: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # the vocabulary is longer than most documents
                piece = b.slice(lo, 256)
                got = np.bincount(np.concatenate([_ids(ids.as_py(), n) for n, ids in zip(piece.column(0).to_pylist(), piece.column(1), strict=True)]))
                short, long = sorted((got, total), key=len)
                total = long.copy()
                total[: len(short)] += short
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    return staged.select("n_tokens", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write all documents' ids as a dataset of token blocks under ``target``."""
    spark = docs.sparkSession
    staged = _stage(docs, path, end_id, id_col, text_col)
    counts = _count_tokens(staged).toPandas()  # at most one row for each vocabulary entry
    table = FrequencyTable.of_counts(counts["token"].to_numpy(), counts["n"].to_numpy())
    totals = {r.part: r.n for r in staged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row for each partition
    bases, at = {}, 0
    for part in sorted(totals):
        bases[part], at = at, at + totals[part]
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(table.tokens, table.freqs, strict=True)], "token long, freq long").coalesce(1).write.parquet(f"{target}/table")
    shared = spark.sparkContext.broadcast((table.tokens, table.freqs))
    schema = pa.schema([("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = FrequencyTable(*shared.value)
        docs_of, lengths, ids, start, following = [], [], [], 0, None

        def close() -> pa.RecordBatch:
            payload = encode_block(np.concatenate(ids), freq)
            return pa.RecordBatch.from_arrays([pa.array([start]), pa.array([docs_of], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)])], schema=schema)

        for b in batches:
            for part, doc, at, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                here = bases[part] + at
                if ids and (here != following or sum(lengths) + n > block_tokens):
                    yield close()
                    docs_of, lengths, ids = [], [], []
                if not ids:
                    start = here
                docs_of.append(doc)
                lengths.append(n)
                ids.append(_ids(data.as_py(), n))
                following = here + n
        if ids:
            yield close()

    staged.mapInArrow(run, "start long, doc_ids array<long>, lengths array<long>, payload binary, crc long").write.option("compression", "none").parquet(f"{target}/blocks")


def read_tokens(spark: SparkSession, source: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from a dataset of token blocks; ids little-endian unsigned 32-bit."""
    pairs = spark.read.parquet(f"{source}/table").toPandas()  # at most one row for each vocabulary entry
    shared = spark.sparkContext.broadcast((pairs["token"].to_numpy(), pairs["freq"].to_numpy()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(*shared.value)
        for b in batches:
            for k in range(b.num_rows):
                start, docs_of, lengths, payload, crc = (b.column(i)[k].as_py() for i in range(5))
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"the block that starts at token {start} is damaged")
                ids = decode_block(payload, table).astype("<u4")
                n = np.array(lengths, np.int64)
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(docs_of, pa.int64()), pa.array(start + at), pa.array(n), pa.array([ids[a : a + m].tobytes() for a, m in zip(at, n, strict=True)], pa.binary())], schema=schema)

    return spark.read.parquet(f"{source}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), target, tokenizer_path())
    # crc32() is Spark's own and runs on the decoded ids, so they needn't leave the executor
    return read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
