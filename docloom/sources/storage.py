"""Tables in the folder that driver and executors share: intermediate ones, and ones that are made once."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local master, which is one machine, gets a folder of its own where that is unset;
    a cluster without it is an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once no plan reads it any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            files, at = _file_system(df.sparkSession, path)
            files.delete(at, True)


def fingerprint(df: DataFrame, *parameters: object) -> str | None:
    """A name for what ``df`` reads from files (their paths, and lengths and times of change in their folders), its plan and ``parameters``;
    None if it reads no files.

    Expression ids differ from plan to plan and are left out.
    """
    paths = sorted(df.inputFiles())
    if not paths:
        return None
    found = []
    for folder in sorted({p.rsplit("/", 1)[0] for p in paths}):  # one listing a folder, not a call a file
        files, at = _file_system(df.sparkSession, folder)
        found += sorted((folder, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(at))
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    said = repr((paths, found, plan, parameters))
    return hashlib.sha256(said.encode()).hexdigest()[:32]


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``: read where a finished one lies there (``_SUCCESS``), else made and written. A half-written one is made anew."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def step(name: str, source: DataFrame, make: Callable[[], DataFrame], *parameters: object) -> DataFrame:
    """A step of a pipeline that is skipped where it has been done: ``make()`` stored under the fingerprint of ``source`` and parameters.

    A source that reads no files has no fingerprint, and its step is done each time.
    """
    mark = fingerprint(source, name, *parameters)
    if mark is None:
        return stored(make())
    return once(source.sparkSession, f"{shared_folder(source.sparkSession)}/step-{name}-{mark}", make)
