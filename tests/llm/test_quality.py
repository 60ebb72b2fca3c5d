"""Held-out quality on generated documents: floors under the figures that the README states."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.llm import toxicity

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_toxicity_on_the_held_out_fold(spark):
    got = toxicity.op7_toxicity(spark, DATA).where("held_out")
    truth = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    both = F.col("predicted") * F.col("toxic")
    r = got.join(truth, "doc_id").agg(F.sum(both).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("real")).first()
    assert r.real > 50
    assert r.hit / r.said >= 0.8, r
    assert r.hit / r.real >= 0.75, r
