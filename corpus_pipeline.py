"""The training-data pipeline over ``documents``: four stages, each written as Parquet and read again.

Every stage takes whatever the one before kept. Null and empty texts have no
words and fail the base quality rule; very long texts are judged, compared and packed
whole. Repeated rows are judged alike and leave one row of their component;
rows of one doc_id are documents of their own. Null doc_ids are kept like
others and come last in a component. Labels that are null, of no id or of no
document count nowhere; without labels, or with too few, the rules are the base rule and the
classifier keeps everything. Without documents every stage is empty. Columns
beside those of documents pass through the first three stages, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagefleet.llm import packing, quality_mil, quality_rules, simhash
from pagefleet.llm.common import spool
from pagefleet.plans.registry import table
from pagefleet.session import configure


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose passages the attention classifier, trained on this stage's input, scores as good."""
    return quality_mil.keep_good(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs, words=3, distance=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 4096 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [("quality_rules", rules_stage), ("quality_classifier", classifier_stage), ("simhash_dedup", dedup_stage),
          ("packing", packing_stage)]

#: Fingerprints, the classifier and the tokenizer have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
