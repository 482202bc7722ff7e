"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fim, htmltext, imi, langid, mixing, resample, secrets, simhash, substrings, tokencount, tokenfile, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.digest_columns(secrets.scan(docs, secrets.train(docs)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocation(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_columns(simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return imi.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(langid.learnable(docs))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_columns(substrings.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest_columns(fim.transform(table(spark, sf_dir, "documents", "doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_decontamination, op4_source_mixing, op5_token_output, op6_html_extraction, op7_simhash_dedup, op8_nearest_neighbours, op9_language_id, op10_warc_derivatives, op11_importance_resampling, op12_substring_dedup, op13_fill_in_middle, pipeline)}

ORACLE = {"op4_source_mixing": mixing.oracle(), "op11_importance_resampling": resample.oracle(), "op12_substring_dedup": substrings.oracle(), "op13_fill_in_middle": fim.oracle()}
