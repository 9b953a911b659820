"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept. All stages but the last return the columns of documents. Null and empty texts score like any text
without words; a null doc_id is never a near duplicate to be dropped, keeps all its words, and is judged like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import bpe, decontaminate, quality, resemblance, substring
from signalloom.llm.common import materialize, table

QUALITY_LEAST = 0.3
SHINGLE_WORDS, RADIUS, SIMILARITY = 5, 3, 0.8
REPEAT_WORDS = 50
BENCHMARK_WORDS = 13
TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.keep_likely(docs, model, QUALITY_LEAST)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return resemblance.drop_near_duplicates(docs, SHINGLE_WORDS, RADIUS, SIMILARITY)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of long passages that a document with a smaller doc_id has too are cut out."""
    return substring.cut_repeats(docs, REPEAT_WORDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty lies inside a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot express the classifier and the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
