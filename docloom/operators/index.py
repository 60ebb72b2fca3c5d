"""A keyword index at rest: postings by bucket of term, written once, extended by segments, read with bucket pruning.

``<path>/postings`` holds (term, doc_id, c, dl), partitioned by segment and bucket (a hash of the term) and sorted by term in each file; a
bucket is dealt over several files by document, so that a term which all documents have is no single task. ``<path>/terms`` holds
(term, df) in the same partitions. ``<path>/segments/<id>`` holds a segment's number of documents and tokens; it is written last, and a segment
without it doesn't exist for readers. A search reads the buckets of its terms, postings once, and writes nothing.

Documents without tokens count in the statistics; ids may not repeat within or across segments (their counts would add up).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import tokenize
from docloom.operators.search import bm25_scores, doc_terms, document_frequency, term_counts
from docloom.sources.storage import exists, fingerprint, shared_folder

#: What a stored index looks like; changes with the layout.
FORMAT = "keyword-index-2"
#: Text bytes of a bucket, and the least and largest number of buckets.
BUCKET_BYTES, BUCKETS, MOST_BUCKETS = 256 << 20, 8, 8192
#: Text bytes behind one file of a bucket: what a writing task reads follows them, whatever the size of the documents.
SLICE_BYTES = 16 << 20
#: Asked terms up to this number go to the postings; more of them meet the postings in a shuffle.
FEW_TERMS = 200_000
#: Inputs of fewer partitions than cores are dealt out before they are tokenised, if they are no larger than this.
SMALL = 1 << 30


def _bytes(df: DataFrame) -> int:
    """The plan's own estimate; rows that come from no files have none and count as few."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 60 else size


def buckets_for(docs: DataFrame) -> int:
    return min(MOST_BUCKETS, max(BUCKETS, _bytes(docs) // BUCKET_BYTES))


def slices_for(docs: DataFrame, buckets: int) -> int:
    return max(1, -(-_bytes(docs) // (buckets * SLICE_BYTES)))


def _spread(df: DataFrame) -> DataFrame:
    """A small input over all cores: one file of one row group is one task else."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if _bytes(df) <= SMALL else df


@dataclass
class KeywordIndex:
    spark: SparkSession
    path: str
    tokens: Callable[[Column | str], Column] = tokenize
    buckets: int = BUCKETS
    key: str = "bigint"  # the type of doc_id

    def bucket(self, term: Column | str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def append(self, docs: DataFrame, text: Column | str = "text") -> KeywordIndex:
        """One more segment, of documents (doc_id, text) that no earlier segment has."""
        segment = uuid.uuid4().hex
        terms = doc_terms(_spread(docs), text, self.tokens)
        rows = term_counts(terms.where("dl > 0")).withColumn("segment", F.lit(segment)).withColumn("bucket", self.bucket("term"))
        slices = slices_for(docs, self.buckets)
        slot = (F.col("bucket") * slices + F.pmod(F.xxhash64("doc_id"), F.lit(slices))).cast("int")
        dealt = rows.repartitionById(self.buckets * slices, slot).sortWithinPartitions("segment", "bucket", "term")
        dealt.write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/postings")
        # what was written tells the tokens; only the number of documents needs the documents again, without their texts
        written = self.postings().where(F.col("segment") == segment)
        frequency = document_frequency(written.select("term")).withColumn("segment", F.lit(segment)).withColumn("bucket", self.bucket("term"))
        frequency.repartition(self.buckets, F.col("bucket")).sortWithinPartitions("segment", "bucket", "term").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/terms")
        total = written.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"))
        count = docs.select("doc_id").agg(F.count(F.lit(1)).alias("n_docs"))
        total.crossJoin(count).coalesce(1).write.parquet(f"{self.path}/segments/segment={segment}")  # two single rows
        return self

    def search(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """(query_id, doc_id, score) by BM25 for queries (query_id, text); repeated terms count as often as they occur."""
        asked = queries.select("query_id", F.explode(self.tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        segments = self.spark.read.parquet(f"{self.path}/segments")
        done = [r.segment for r in segments.select("segment").distinct().collect()]  # a row for each append
        stats = segments.agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens")).select("n_docs", F.when(F.col("n_docs") > 0, F.col("tokens") / F.col("n_docs")).otherwise(1.0).alias("avg_len"))
        counts = asked.groupBy(self.bucket("term").alias("b")).count().collect()  # at most ``buckets`` numbers
        wanted, few = [r.b for r in counts], sum(r["count"] for r in counts) <= FEW_TERMS
        here = F.col("segment").isin(done) & F.col("bucket").isin(wanted)
        df = self._read("terms", "term string, df bigint").where(here).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        return bm25_scores(asked, df, self.postings().where(here).drop("segment", "bucket"), stats, few)

    def postings(self) -> DataFrame:
        return self._read("postings", f"term string, doc_id {self.key}, c bigint, dl int")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, segment string, bucket int").parquet(f"{self.path}/{name}")


def build_index(docs: DataFrame, path: str | None = None, text: Column | str = "text", tokens: Callable = tokenize, buckets: int = 0) -> KeywordIndex:
    """An index of documents (doc_id, text) at ``path``, by default a new one in the shared folder, with buckets by their size."""
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs)
    return KeywordIndex(spark, path or f"{shared_folder(spark)}/keyword-index-{uuid.uuid4().hex}", tokens, buckets, dict(docs.dtypes)["doc_id"]).append(docs, text)


def index_of(docs: DataFrame, text: str = "text", tokens: Callable = tokenize) -> KeywordIndex:
    """The index of documents that lie in files: built at the first call, found by later ones for as long as the files stay as they are."""
    spark = docs.sparkSession
    mark, buckets = fingerprint(docs.select("doc_id", text), FORMAT, tokens.__name__), buckets_for(docs)
    if mark is None:
        return build_index(docs, None, text, tokens, buckets)
    path = f"{shared_folder(spark)}/keyword-index-{mark}"
    found = KeywordIndex(spark, path, tokens, buckets, dict(docs.dtypes)["doc_id"])
    return found if exists(spark, f"{path}/segments") else found.append(docs, text)
