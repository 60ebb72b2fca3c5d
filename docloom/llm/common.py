"""Helpers shared by the training-data operators: scans, shared storage, UTF-8 access to Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        # a local master is one machine; on a cluster the warehouse is the folder that all share
        local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        found = f"file://{tempfile.mkdtemp(prefix='docloom-')}" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.docloom"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer partitions than those (one small file): for work that outweighs a shuffle of the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the rows outlive the executor that made them, and later readers prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._docloom_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more, and let Spark drop the shuffles behind it."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._docloom_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if stored:
        # shuffle files go when the driver's JVM finds their plans unreachable, which may else be long after
        gc.collect()
        stored[0].sparkSession._jvm.System.gc()


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front until none clashes with ``columns`` (whatever their case)."""
    known = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in known:
            n = f"_{n}"
        known.add(n.lower())
        out.append(n)
    return out


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and so would their high-water marks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def local_path(uri: str) -> str:
    """The path under which Python opens what Spark calls ``uri``; only mounted (file) storage has one."""
    if uri.startswith("file:"):
        uri = uri[5:]
        return "/" + uri.lstrip("/")
    if "://" in uri:
        raise ValueError(f"no mounted path for {uri}")
    return uri


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased: what bytes.lower() and split() do."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: Odd multipliers for combining hashes, from the fractional parts of a Weyl sequence.
MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(1, 9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads combined hashes over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def row_crc(doc_id: int | None) -> int:
    """crc32 of the id as text, as SQL computes it; null ids give 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies on this machine (a parameter everywhere; never copied)."""
    override = os.environ.get("DOCLOOM_TOKENIZER")
    if override:
        return override
    import public_tokenizers

    return public_tokenizers.path(name)
