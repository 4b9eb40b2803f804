"""The training-data pipeline: quality rules, quality classifier, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
``documents``.  Rows without an id are never dropped by the two stages that join by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import decontaminate, near_dedup, packing, quality_model, quality_rules
from fieldweave.llm.queries import vocabulary_path
from fieldweave.llm.scratch import Scratch

#: Documents whose calibrated probability of quality is below this go.
QUALITY_THRESHOLD = 0.3
MAX_TOKENS = 2048


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs, "v1")


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_model.keep_documents(docs, labels, QUALITY_THRESHOLD)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_documents(docs, size=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.clean_documents(docs, items, size=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, vocabulary_path(), max_tokens=MAX_TOKENS, end_id=0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_quality),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_copies),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
