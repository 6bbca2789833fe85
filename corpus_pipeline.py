"""From documents to packed training sequences: five stages, each written as Parquet and read by the next.

Cases, for every stage: null and empty texts pass the filters (no evidence of toxicity, no shingles) and are taken by no mix,
as they have no words; rows listed twice count as copies, of which one stays; rows of one doc_id with different texts are
different documents; further columns, of any name, are passed on up to the last stage; empty tables give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import jaccard, mixing, packing, pii, toxicity
from gleaner.llm.common import checkpoint_folder, documents
from gleaner.llm.queries import PII_KEY, TOKENIZER

#: No single SQL statement fits the learned models, the tokenizer and the keyed draws; tests hold stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, percent=80)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replaced(docs, PII_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 2048)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("pii", replace_pii), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's output is removed once the next one is written; the last stays, as the result reads it."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        now = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(now), now
    return docs
