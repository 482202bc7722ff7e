"""A corpus pipeline in five stages, each applying a module of ``waymesh.llm`` to all that its predecessor kept.

Every stage takes and returns the columns of ``documents`` (the last returns the token index); between stages the
documents are a table in the shared folder. Defined cases: null texts are empty texts, in which no language is found; a
null doc_id is an id like any other to every stage but the second, which keeps the row without an id only if no row of
its group has one; repeated rows are one document from the second stage on; extra columns stay, whatever their names;
an empty table, or one that a stage has emptied, goes through all stages; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import decontam, jaccard, langid, mixing, simhash, tokenfile
from waymesh.llm.common import scratch, table

#: Parameters: a document is kept if a language is found with at least this posterior.
MIN_SCORE = 0.5


def columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found: no letter, or no language of at least MIN_SCORE."""
    model = langid.train(langid.learnable(docs))
    marked = langid.identify(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return columns(marked.filter((F.col("__lang") != "und") & (F.col("__score") >= MIN_SCORE)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the smallest doc_id, once.

    A group is what links of two kinds connect: those of operator 7, fingerprints that differ in two bits at most, and
    pairs of similarity 0.8 or more on five-word shingles, most of which differ in more bits than that.
    """
    near = simhash.near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"))
    groups = near.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return columns(jaccard.first_of_each(docs, also=groups), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontam.marked(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return columns(found.filter(~F.col(decontam.MARK)["contaminated"]), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights ask for."""
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the mixture into token files and returns their index, read back."""
    return tokenfile.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: Language models, fingerprints and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
