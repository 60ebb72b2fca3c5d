"""Media columns: payloads as PNG members of archives, written and read by a custom Spark data source.

``PayloadArchive`` is a Python data source named ``payload_archive``. An archive is a file of members, then a directory
of fixed-size entries (key, offset, length, CRC) and a footer. Writing: each task streams Arrow batches into an archive
under a temporary name; the driver's commit renames the finished ones, so a lost executor or a retried task leaves no
half archive. Reading: the driver reads footers only (24 bytes an archive) and plans byte ranges of about ``range_bytes``;
a task reads the directory entries whose members begin in its range and streams the payloads in Arrow batches. A member that
can't be read or fails its CRC is retried on its own, by its offset, up to ``retries`` times.

A payload is UTF-8 text, filled up with bytes 255 to a positive multiple of 576, stored as an 8-bit grey-scale PNG of 576
samples a row (filter type 0), which is lossless.

Defined results: null text counts as empty (one row of 255s); equal texts give equal values; keys may be null or repeat;
no rows give no archives, and an empty folder reads as no rows. Archives need storage that executors can open as files,
such as a mounted shared folder.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docloom.llm.common import local_path, read_table, shared_path, spread

WIDTH = 576
_ENTRY, _FOOTER = struct.Struct("<?xxxxxxxqQQIxxxx"), struct.Struct("<QQ8s")
_MAGIC, _DDL = b"DLARCH01", "key long, payload binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("payload", pa.binary())])
#: Fixed values of the PNG format.
_PNG, _GREY8 = b"\x89PNG\r\n\x1a\n", (8, 0, 0, 0, 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """8-bit grey-scale PNG with rows of ``WIDTH`` samples; the payload is a positive multiple of that."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">II5B", WIDTH, len(rows), *_GREY8)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote, all checksums verified."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, width = 8, b"", 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def feature(payload: bytes) -> str:
    """Integer features of the samples: mean and variance (times 1000), changes a thousand, and an 8-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    n, histogram = len(x), np.bincount(x, minlength=256)
    value = np.arange(256)
    total, squares = int(histogram @ value), int(histogram @ (value * value))
    changes = int(np.count_nonzero(x[1:] != x[:-1]))
    bins = histogram.reshape(8, 32).sum(1).tolist()
    return f"mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};changes={changes * 1000 // n};hist={','.join(map(str, bins))}"


@dataclass
class _Written(WriterCommitMessage):
    temporary: str | None
    members: int


@dataclass
class _Range(InputPartition):
    path: str
    directory: int
    entries: int
    low: int
    high: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        name, entries, out, at = f"{self.folder}/.{uuid.uuid4().hex}.tmp", [], None, 0
        try:
            for batch in iterator:
                out = out or open(name, "wb", buffering=1 << 20)
                for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload"), strict=True):
                    data = payload.as_py() or b""
                    out.write(data)
                    entries.append(_ENTRY.pack(key is None, key or 0, at, len(data), zlib.crc32(data)))
                    at += len(data)
        except BaseException:  # the driver hears nothing of a failed task's file
            if out is not None:
                out.close()
                os.remove(name)
            raise
        if out is None:
            return _Written(None, 0)
        with out:
            out.write(b"".join(entries))
            out.write(_FOOTER.pack(at, len(entries), _MAGIC))
        return _Written(name, len(entries))

    def commit(self, messages: list[_Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for m in messages:
            if m and m.temporary:
                os.replace(m.temporary, f"{self.folder}/{os.path.basename(m.temporary)[1:-4]}.arch")

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, retries: int, batch_bytes: int):
        self.folder, self.range_bytes, self.retries, self.batch_bytes = folder, range_bytes, retries, batch_bytes

    def partitions(self) -> list[_Range]:
        found = []
        for name in sorted(os.listdir(self.folder) if os.path.isdir(self.folder) else ()):
            if not name.endswith(".arch"):
                continue
            with open(path := f"{self.folder}/{name}", "rb") as f:
                f.seek(-_FOOTER.size, os.SEEK_END)
                directory, entries, magic = _FOOTER.unpack(f.read(_FOOTER.size))
            if magic != _MAGIC:
                raise ValueError(f"{path} is no payload archive")
            # an empty member may lie at the very end, hence one byte more
            found += [_Range(path, directory, entries, low, low + self.range_bytes) for low in range(0, directory + 1, self.range_bytes)]
        return found or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.entries:
            return
        with open(partition.path, "rb") as f:
            first = self._at_or_after(f, partition, partition.low)
            last = self._at_or_after(f, partition, partition.high)
            f.seek(partition.directory + first * _ENTRY.size)
            directory = f.read((last - first) * _ENTRY.size)
            keys, payloads, held = [], [], 0
            for null, key, offset, length, crc in _ENTRY.iter_unpack(directory):
                payloads.append(data := self._member(f, partition.path, offset, length, crc))
                keys.append(None if null else key)
                held += len(data)
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], schema=_SCHEMA)
                    keys, payloads, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], schema=_SCHEMA)

    @staticmethod
    def _at_or_after(f, partition: _Range, offset: int) -> int:
        """The first directory entry whose member begins at ``offset`` or later, by binary search on disk."""
        low, high = 0, partition.entries
        while low < high:
            middle = (low + high) // 2
            f.seek(partition.directory + middle * _ENTRY.size)
            if _ENTRY.unpack(f.read(_ENTRY.size))[2] < offset:
                low = middle + 1
            else:
                high = middle
        return low

    def _member(self, f, path: str, offset: int, length: int, crc: int) -> bytes:
        for attempt in range(self.retries + 1):
            try:
                if attempt:
                    time.sleep(0.05 * 2**attempt)
                    with open(path, "rb") as again:  # a handle of its own: the old one may be what failed
                        again.seek(offset)
                        data = again.read(length)
                else:
                    f.seek(offset)
                    data = f.read(length)
                if len(data) == length and zlib.crc32(data) == crc:
                    return data
                problem = "its CRC is wrong"
            except OSError as e:
                problem = str(e)
        raise OSError(f"{path}: the member at offset {offset} can't be read: {problem}")


class PayloadArchive(DataSource):
    """Options: path, rangebytes, retries, batchbytes."""

    @classmethod
    def name(cls) -> str:
        return "payload_archive"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema: StructType) -> _Reader:
        get = self.options.get
        return _Reader(local_path(self.options["path"]), int(get("rangebytes", 16 << 20)), int(get("retries", 3)), int(get("batchbytes", 4 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(local_path(self.options["path"]))


def store_texts(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every text as a PNG member of the archives under ``target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                piece = b.slice(lo, 512)
                stored = [to_png(padded((t.as_py() or "").encode())) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(stored, pa.binary())], schema=_SCHEMA)

    docs.sparkSession.dataSource.register(PayloadArchive)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    rows = spread(rows).mapInArrow(run, _DDL)
    rows.write.format("payload_archive").mode("append").save(target)


def load_media(spark: SparkSession, source: str) -> DataFrame:
    """(key, payload) of all members: the stored form."""
    spark.dataSource.register(PayloadArchive)
    return spark.read.format("payload_archive").load(source)


def media_features(media: DataFrame) -> DataFrame:
    """Per member: sizes and digests of the samples and of the stored form, and the feature string.

    The unpadded size is what is left without the closing 255s: no UTF-8 text holds that byte.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stored in b.column(1):
                data = stored.as_py()
                payload = from_png(data)
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema=schema)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_path(spark, "media")
    store_texts(read_table(spark, sf_dir, "documents"), target)
    return media_features(load_media(spark, target))
