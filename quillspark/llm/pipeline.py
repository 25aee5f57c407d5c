"""Stages of the corpus pipeline: bad, toxic and repeated documents go, personal data is masked, the rest is packed.

Defined results of every stage: null ids and null texts (which count as empty)
stay as they are, or go where the stage's operator decides so; columns, whatever
their names, stay in all stages but the last; repeated rows are judged each,
and of rows that repeat id and text the third stage keeps one; scores of exactly
0.5 are good in the first stage and toxic in the second; of a group of
near-duplicates the smallest id stays, of equal ids the smallest text hash; an
empty table stays empty; very long texts are taken whole, as in the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import packing, personal_data, quality, simhash, toxicity
from .common import documents, give_back, staged
from .labelled import learns


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that it rejects go."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learns(3, 1)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that it rejects go."""
    kept = toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learns(5, 0))[0])
    give_back()  # from here the broadcast holds the model
    return kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group stays."""
    return simhash.one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: spans become marks."""
    return personal_data.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; what each stage keeps is written and read again for the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
