"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data gets surrogates, sources are mixed, and what remains is packed.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet and reread. An empty table stays empty; all but
the last keep the columns of documents and any others, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import mixing, packing, pii, simhash, toxicity
from siftwood.llm.textkit import ensure_checkpoint_dir, free_name, read

#: Not expressible in SQL (a fitted classifier, hash fingerprints and a tokenizer); tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below the threshold; null and empty texts score like texts of no known word and stay, repeated rows are judged alike."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest id's; of its repeated rows the first in order. Texts without a word are one group; rows without an id stay."""
    return simhash.deduplicated(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with surrogates in its text and n_chars counted anew; null texts stay null."""
    told = free_name(docs, "entities")
    replaced = pii.checked(pii.pseudonymised(docs, pii.key_of(spark), entities_col=told), told)
    return replaced.drop(told).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix draws; null sources and languages form groups of their own, equal ids are drawn alike."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row (null text: empty) and their places; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{shared.rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
