"""The queries that apply each training-data operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import ann, classifier, divergence, htmltext, lexical, lmscore, mixing, packing, pii, quotes, rules, sharding, simhash
from textloom.llm.common import place_in_file, table


#: No secret: a production job passes a key of its own.
EXAMPLE_KEY = "textloom-example-key"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_site_bayes_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_projected_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return quotes.conversations(quotes.link(turns, row=place_in_file(turns)))


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op11_byte_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op13_threshold_seeded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_bayes_classifier": op1_site_bayes_classifier,
    "op2_projected_kd_tree": op2_projected_kd_tree,
    "op3_cube_mixing": op3_cube_mixing,
    "op4_bloom_lm": op4_bloom_lm,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_histogram_sort": op6_histogram_sort,
    "op7_sum_of_squares_packing": op7_sum_of_squares_packing,
    "op8_pivot_simhash": op8_pivot_simhash,
    "op9_ngram_quality_rules": op9_ngram_quality_rules,
    "op10_feistel_pseudonyms": op10_feistel_pseudonyms,
    "op11_byte_divergence_audit": op11_byte_divergence_audit,
    "op12_wrapper_induction": op12_wrapper_induction,
    "op13_threshold_seeded_search": op13_threshold_seeded_search,
}

ORACLE_SQL: dict[str, str] = {"op11_byte_divergence_audit": divergence.SQL, "op13_threshold_seeded_search": lexical.SQL}
