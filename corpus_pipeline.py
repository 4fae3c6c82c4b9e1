"""The corpus pipeline: documents pass quality rules, toxicity, near-deduplication, redaction and packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is written as Parquet and
read again before the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociframe.llm import minhash, packing, pii, quality, toxicity
from lociframe.llm.common import checkpoint_dir

#: Similarity, in hundredths, from which the near_dedup stage links documents.
SIMILARITY = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that a learned rule marks go."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, rules)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Documents of a similarity of 0.8 or more link."""
    return minhash.keep_one_of_each(docs, similarity=SIMILARITY)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows."""
    return pii.redact_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_deduplication),
    ("pii", redaction),
    ("packing", packed_sequences),
]

#: Learned models, tokenizers and near-duplicate search are beyond SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/lociframe/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
