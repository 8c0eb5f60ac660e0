"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Before each, executors give back what
the one before has left, so that memory does not add up over the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from tessera.llm.common import cleared, id_hash, stored

ORACLE_SQL = None  # the toxicity model and the tokenizer are not SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, fitted on the labels, does not call toxic."""
    cleared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_from(docs, labels, id_hash() % 5 == 0)
    return toxicity.drop_toxic(docs, model)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but one of the documents whose texts are equal but for white space."""
    cleared(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.75 of their five-word shingles, the smallest doc_id."""
    cleared(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    cleared(spark)
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of what is left lies in sequences of 2048 tokens."""
    cleared(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_repeats), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
