"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents, the last one its result.

NULL and empty texts pass the first three stages as they are; source mix draws
none of them. Repeated rows are judged one by one (near copies keep the smallest
doc_id, repeated passages the first start). Other columns of ``documents`` travel
along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelkit.llm.bpe import token_digests
from funnelkit.llm.mixing import mixed_documents
from funnelkit.llm.ngram_join import keep_one
from funnelkit.llm.shared import stage
from funnelkit.llm.substring import remove_duplicates
from funnelkit.llm.toxicity import drop_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (word 5-grams, Jaccard 0.8) stays."""
    return keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that start earlier are cut out of the texts."""
    return remove_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a document appears as often as it is taken."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's text, encoded and decoded."""
    return token_digests(docs)


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard_join", one_of_each_group),
          ("substring_dedup", cut_repeated_passages), ("source_mix", mix_to_weights),
          ("bpe_automaton", tokenize)]

#: no SQL form: the toxicity model and the sampling hashes have none in DuckDB
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
