"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. Each text becomes its SHA-256 digest; only (id, digest) go on, so texts are never shuffled.
2. A frequent-items summary of the Misra-Gries family (``approx_top_k_accumulate`` and ``_combine``: mergeable counters, ``tracked``
   of them, over 64-bit hashes of the digests; one of more than ``rows / tracked`` occurrences is never missed) names
   candidate heavy digests.
3. Candidates are counted exactly; their verified winners (at most ``heavy`` rows, so the broadcast is bounded by a
   parameter and not by the data) decide the fate of heavy rows on the map side, without a shuffle.
4. The remaining digests, each of them rare, go through an ordinary shuffle.

Defined results: a null text counts as empty, and empty texts equal one another. Of equal texts the largest id stays;
null ids order below all others. Rows repeated with the same id and text share one decision. An empty table gives an
empty result. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh, materialize, read_table

#: Heavy digests that may be broadcast, counters of the frequent-items summary, and groups in which summaries are merged first.
HEAVY, TRACKED, MERGED = 1_000, 10_000, 1_024


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) for every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))


def frequent_hashes(rows: DataFrame, key: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(hash): 64-bit hashes of at most ``heavy`` frequent values of ``key``; candidates, to be counted exactly.

    Summaries hold ``tracked`` numbers of 8 bytes and are merged in two levels, so no task merges those of all others.
    """
    state = f"approx_top_k_accumulate(xxhash64(`{key}`), {tracked})"
    local = rows.withColumn("part", F.spark_partition_id() % MERGED).groupBy("part").agg(F.expr(state).alias("state"))
    top = local.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))  # no rows, no group
    found = top.select(F.explode(F.expr(f"approx_top_k_estimate(state, {heavy})")).alias("c"))
    return found.where("c.count > 1").select(F.col("c.item").alias("hash"))


def with_groups(rows: DataFrame, key: str, *aggregates: F.Column, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of a *stored* table, each with ``aggregates`` over all rows of its ``key`` (not null).

    Rows of frequent keys get theirs from a broadcast of at most ``heavy`` verified groups, without a shuffle; the others,
    whose groups are small, by an ordinary one.
    """
    hashes = materialize(frequent_hashes(rows, key, heavy, tracked), "frequent")
    hot = rows.withColumn("hash", F.xxhash64(key)).join(F.broadcast(hashes), "hash", "left_semi").drop("hash")
    winners = materialize(hot.groupBy(key).agg(*aggregates).withColumn("hot", F.lit(True)), "heavy")
    split = rows.join(F.broadcast(winners), key, "left")
    cold = split.where("hot is null").select(rows.columns)
    groups = cold.groupBy(key).agg(*aggregates)
    return split.where("hot").drop("hot").unionByName(cold.join(groups, key))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(text_digests(docs, id_col, text_col), "digests")
    grouped = with_groups(digests, "text_sha256", F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), heavy=heavy, tracked=tracked)
    return grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, each once, with all their columns.

    Rows repeated with one id and text come down to one; join and removal share one partitioning, hence one shuffle.
    """
    key, null, digest = names = fresh(docs.columns, "stay_id", "stay_null", "stay_digest")
    stays = exact_dedup(docs, id_col, text_col).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias(key), F.col("doc_id").isNull().alias(null), F.col("text_sha256").alias(digest))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), null: F.col(id_col).isNull(), digest: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    return keyed.join(stays, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
