"""A worker that outlives its tasks keeps no encoder of them."""

import os

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from signalloom.llm import bpe


def test_a_worker_keeps_no_encoder_after_a_task(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string").coalesce(1)

    @F.pandas_udf("struct<pid long, kept long>")
    def kept(ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"pid": [os.getpid()] * len(ids), "kept": [bpe.load.cache_info().currsize] * len(ids)})

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert out.count() == 20 and out.agg(F.sum("n_tokens")).first()[0] > 20
    assert {r.k.kept for r in spark.range(8, numPartitions=8).select(kept("id").alias("k")).collect()} == {0}
